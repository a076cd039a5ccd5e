"""The document stream: one row a document, with the position that stands for stream order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.functions.text import is_manual
from sarit.plans.scale import broadcast_if_small, spread, table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """pos, text, source (unknown where null), manual, lang and the given other columns of the table documents."""
    names = ("doc_id", "text", "source", "manual", "source_type", "lang", *columns)
    df = spread(table(spark, sf_dir, "documents", *names))
    return df.select(F.col("doc_id").alias("pos"), "text", F.coalesce("source", F.lit("unknown")).alias("source"), is_manual(F.col("manual"), F.col("source_type")).alias("manual"), "lang", *columns)


def fold_hosts(df: DataFrame, registry: DataFrame) -> DataFrame:
    """df with a host in source replaced by its site's name; the registry is broadcast if it is counted to be small."""
    hosts = registry.where("host is not null").groupBy(F.col("host").alias("_host")).agg(F.min("site").alias("_site"))
    return df.join(broadcast_if_small(hosts), F.col("source") == F.col("_host"), "left").withColumn("source", F.coalesce("_site", "source")).drop("_host", "_site")


def not_empty(df: DataFrame) -> DataFrame:
    """df without null and empty texts. A filter on a computed text would be pushed below the projection and compute it
    twice; generating the rows computes it once."""
    columns = df.columns
    return df.select(*(c for c in columns if c != "text"), F.explode(F.filter(F.array("text"), lambda x: x != "")).alias("text")).select(*columns)


def kept_and_dropped(df: DataFrame) -> DataFrame:
    """One row: how many texts not_empty() keeps, and how many it drops."""
    some = F.coalesce(F.col("text") != "", F.lit(False))
    return df.agg(F.count_if(some).alias("kept"), F.count_if(~some).alias("dropped"))
