"""Exact quantiles and ranks without sorting a table in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarit.plans.scale import cut

#: Cells between the least and the greatest value, and most values that one task may sort.
CELLS, SORTED = 65_536, 1_000_000


def quantiles(df: DataFrame, column: str, shares: list[float], most: int = SORTED) -> list[float | None]:
    """The quantiles of a column's finite values, linear between neighbours; None for each without values.

    Up to `most` values are sorted by one task. More are counted by cell (of their range's logarithm where all are positive), and only the cells that hold a
    wanted rank are looked at again, as counts of their distinct values."""
    value = F.col(column)
    real = cut(df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(value.cast("double").alias("x")))
    n, low, high = real.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None for _ in shares]
    if n <= most:
        return list(real.agg(F.percentile("x", F.array(*(F.lit(float(s)) for s in shares)))).first()[0])
    scale = (lambda x: F.log(x)) if low > 0 else (lambda x: x)
    least, most = (math.log(low), math.log(high)) if low > 0 else (low, high)
    celled = real.withColumn("cell", F.floor((scale(F.col("x")) - least) / max(most - least, 1e-300) * (CELLS - 1)) if most > least else F.lit(0).cast("bigint"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))  # at most CELLS rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before)
    ranks = sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    holds = sizes.where(" or ".join(f"(before <= {r} and before + n > {r})" for r in ranks)).drop("n")
    counts = celled.join(F.broadcast(holds), "cell").groupBy("cell", "before", "x").agg(F.count("*").alias("n"))
    inside = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.withColumn("from", inside).where(" or ".join(f"(`from` <= {r} and `from` + n > {r})" for r in ranks)).select("from", "n", "x").collect()  # one row a rank at most
    at = {r: next(x.x for x in rows if x["from"] <= r < x["from"] + x.n) for r in ranks}
    out = []
    for share in shares:
        place = share * (n - 1)
        one, two = at[math.floor(place)], at[math.ceil(place)]
        out.append(one + (two - one) * (place - math.floor(place)))
    return out


def first_in_order(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows of least `order`, whose values are unique: the border is found by counts, no row is sorted or moved."""
    from sarit.operators.ngram import running_total

    places = df.select(order, F.lit(1).alias("_one"))
    border = cut(running_total(places, order, "_one").where(F.col("before") == n - 1).select(F.col(order).alias("_border")))
    found = border.first()
    return df if found is None else df.where(F.col(order) <= found["_border"])
