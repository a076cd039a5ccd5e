"""The frontier and the document counts as streams: files that arrive are merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def crawl_events(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """host, window of a day, states and characters of crawl events (url, host, crawl_state, n_chars, seen_at); events
    later than the watermark are left out, a URL counts once a state and day."""
    known = stream.where("seen_at is not null").withWatermark("seen_at", late).withColumn("_day", F.date_trunc("day", "seen_at"))
    once = known.dropDuplicatesWithinWatermark(["url", "crawl_state", "_day"])
    return once.groupBy(F.window("seen_at", "1 day").alias("day"), "host", "crawl_state").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a batch's new URLs to the frontier table at path. A batch writes its own folder with the new
    URLs only, those of no earlier batch, so a batch run again after a failure gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [f"{path}/batch={i}" for i in range(number)]
        known = spark.read.parquet(*before).select("url") if before else spark.createDataFrame([], "url string")
        rest = sorted(set(batch.columns) - {"url", "priority"})
        one = batch.where("url is not null").groupBy("url").agg(F.min(F.struct("priority", *rest)).alias("x")).select("url", "x.*")
        one.join(known, "url", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def follow(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    """Merges the parquet files of a folder into the frontier at path until none is left."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
