"""Problem 3: mixing sources to target weights.

Method: Pareto order sampling. A source's target is its share of the total; as many whole copies of its rows as fit
are certain, and what is left is sampled: each row's inclusion probability grows with the square root of its length (rows
whose probability would pass 1 are certain, the others share what these leave), rows are ranked by random odds divided by inclusion odds, and the ranking is cut where the characters come nearest to
what is left. The total is the largest at which every source that has rows can reach its share with no row used more
than max_repeat times, unless one is given; a source that can't reach its share of a given total gives all it may.

Only train rows with a text of at least one character take part. A host counts as its site; rows of a null source, or
of a source without a target, are left out. A source without rows reaches a share of 0, and the others keep their
proportions. Targets that are null or not positive are left out; a null max_repeat means 1. Rows that occur twice are
rows of their own. The random odds depend on the seed and row_id only, so the mix can be repeated.

No source is ever sorted in one task: the ranking is cut with a histogram of the odds' logarithm (CELLS cells for
each source) and only the cell at the cut is ordered. Plans have a row for each source of mix_targets, checked to be
few before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sarit.llm.repeated_lines import with_site
from sarit.plans.scale import broadcast_if_small, cut, table

SEED = 1337
#: Cells of the histogram of log odds in [-LOG_ODDS, LOG_ODDS].
CELLS, LOG_ODDS = 65_536, 60.0
#: Largest inclusion probability that has odds.
CERTAIN = 1 - 1e-12


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, site, n_chars of the rows that take part, before the targets are looked at."""
    rows = table(spark, sf_dir, "split_docs", "row_id", "text", "source", "split").where("split = 'train' and length(text) > 0 and source is not null")
    return with_site(rows, table(spark, sf_dir, "registry", "site", "host")).select("row_id", "site", F.length("text").cast("bigint").alias("n_chars"))


def plan(rows: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """For each source of the targets: available, budget, whole copies, characters left to sample, sum of weights."""
    targets = targets.where("source is not null and target_share > 0").groupBy(F.col("source").alias("site")).agg(F.sum("target_share").alias("target_share"), F.coalesce(F.max("max_repeat"), F.lit(1)).alias("max_repeat"))
    sizes = rows.groupBy("site").agg(F.sum("n_chars").alias("available"), F.sum(F.pow("n_chars", F.lit(1.5))).alias("weighted"))
    out = targets.join(sizes, "site", "left")
    most = out.agg(F.min(F.col("available") * F.col("max_repeat") / F.col("target_share"))) if total is None else None
    known = cut(out.crossJoin(F.broadcast(most.toDF("total"))) if total is None else out.withColumn("total", F.lit(float(total))))  # most is one row
    budget = F.least(F.col("target_share") * F.col("total"), F.col("max_repeat") * F.col("available"))
    whole = F.least(F.floor(budget / F.col("available") + 1e-9), F.col("max_repeat").cast("bigint"))
    known = known.withColumn("budget", budget).withColumn("whole", F.coalesce(whole, F.lit(0)))
    return cut(known.withColumn("left", F.greatest(F.coalesce(F.col("budget") - F.col("whole") * F.col("available"), F.lit(0.0)), F.lit(0.0))))


def with_chances(plans: DataFrame, rows: DataFrame) -> DataFrame:
    """The plans with longest, rest and weights: rows of more characters than `longest` are certain, what is left beside them
    is `rest`, and a row of n others has the chance sqrt(n) rest / weights, which is never over 1.

    A chance grows with the length, so the certain rows of a source are its longest. Lengths are counted first, and what
    is summed in order are a source's different lengths."""
    lengths = rows.join(broadcast_if_small(plans.select("site", "left").where("left > 0")), "site").groupBy("site", "left", "n_chars").agg(F.count("*").alias("_n"))
    longer = F.coalesce(F.sum(F.col("_n") * F.col("n_chars")).over(Window.partitionBy("site").orderBy(F.desc("n_chars")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum(F.col("_n") * F.pow("n_chars", F.lit(1.5))).over(Window.partitionBy("site").orderBy("n_chars"))
    each = lengths.withColumn("rest", F.greatest(F.col("left") - longer, F.lit(0.0))).withColumn("weights", upto)
    fits = each.where(F.sqrt("n_chars") * F.col("rest") <= F.col("weights"))
    best = fits.groupBy("site").agg(F.max_by(F.struct(F.col("n_chars").alias("longest"), "rest", "weights"), "n_chars").alias("x")).select("site", "x.*")
    return plans.join(best, "site", "left")


def mix(rows: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, known: DataFrame | None = None) -> DataFrame:
    """row_id, source, n_chars, copies of the rows that are used; known: the plan, if there is one already."""
    plans = broadcast_if_small(cut(with_chances(plan(rows, targets, total) if known is None else known, rows)))
    known = rows.join(plans, "site")
    chance = F.when(F.coalesce(F.col("n_chars") > F.col("longest"), F.lit(True)), CERTAIN).otherwise(F.least(F.greatest(F.sqrt("n_chars") * F.col("rest") / F.col("weights"), F.lit(1e-12)), F.lit(CERTAIN)))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    log_odds = F.log(unit) - F.log1p(-unit) - (F.log(chance) - F.log1p(-chance))
    cell = F.floor((F.least(F.greatest(log_odds, F.lit(-LOG_ODDS)), F.lit(LOG_ODDS)) + LOG_ODDS) / (2 * LOG_ODDS) * (CELLS - 1))
    ranked = known.select("row_id", "site", "n_chars", "whole", "left", log_odds.alias("log_odds"), cell.alias("cell"))
    cells = ranked.where("left > 0").groupBy("site", "cell").agg(F.sum("n_chars").alias("size"), F.first("left").alias("left"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("site").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before)
    border = cut(cells.where("before < left and before + size >= left").groupBy("site").agg(F.min(F.struct("cell", "before")).alias("x")).select("site", F.col("x.cell").alias("border"), "x.before"))
    ranked = ranked.join(broadcast_if_small(border), "site", "left")
    inside = ranked.where("cell = border and left > 0")
    running = F.sum("n_chars").over(Window.partitionBy("site").orderBy("log_odds", "row_id", "n_chars").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("picked", F.when(F.col("before") + running - F.col("n_chars") / 2 <= F.col("left"), 1).otherwise(0))
    outside = ranked.where("border is null or cell <> border or left <= 0").withColumn("picked", F.when((F.col("left") > 0) & (F.col("cell") < F.col("border")), 1).otherwise(0))
    columns = ("row_id", F.col("site").alias("source"), "n_chars", (F.col("whole") + F.col("picked")).cast("int").alias("copies"))
    return inside.select(*columns).unionAll(outside.select(*columns)).where("copies > 0")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_mix: row_id, source, n_chars, copies."""
    return mix(candidates(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_shares: source, target_share, max_repeat, n_chars (available), n_chars_used, share_reached, most_copies."""
    rows, targets = candidates(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    known = plan(rows, targets)
    used = mix(rows, targets, known=known).groupBy("source").agg(F.sum(F.col("n_chars") * F.col("copies")).alias("n_chars_used"), F.max("copies").alias("most_copies"))
    plans = known.select(F.col("site").alias("source"), "target_share", "max_repeat", F.coalesce("available", F.lit(0)).alias("n_chars"))
    out = cut(plans.join(used, "source", "left").fillna(0, ["n_chars_used", "most_copies"]))
    share = F.col("n_chars_used") / F.col("all_used")
    return out.crossJoin(F.broadcast(out.agg(F.sum("n_chars_used").alias("all_used")))).withColumn("share_reached", share).drop("all_used")  # one row
