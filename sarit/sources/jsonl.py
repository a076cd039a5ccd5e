"""JSON-lines and shard sources and sinks."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.functions.text import strip
from sarit.operators.ngram import running_total
from sarit.operators.quantiles import first_in_order

DOCUMENT = "doc_id string, text string, content string, lang string, source string, source_type string, manual boolean, url string, fetched_at string"
MODES = {"skip": "DROPMALFORMED", "fail": "FAILFAST", "count": "PERMISSIVE"}


def read(spark: SparkSession, paths: str | list[str], schema: str = DOCUMENT, malformed: str = "skip") -> DataFrame:
    """Records of one or more files (globs, gzip and bzip2 too). malformed: skip drops bad lines, fail raises, count
    keeps them in the column _corrupt_record. Blank lines are no records. The column _file tells the file."""
    if malformed == "count":
        schema = f"{schema}, _corrupt_record string"
    return spark.read.schema(schema).option("mode", MODES[malformed]).json(paths).select("*", F.col("_metadata.file_name").alias("_file"))


def malformed_by_file(spark: SparkSession, paths: str | list[str], schema: str = DOCUMENT) -> DataFrame:
    """_file, n_lines, n_malformed."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("_file"), F.trim("value").alias("line")).where("line <> ''")
    bad = F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"]
    return lines.groupBy("_file").agg(F.count("*").alias("n_lines"), F.count(bad).alias("n_malformed"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, length, reason of the files of a folder itself: why one is skipped, null if it is read. The names come from
    the file system, since Spark's file sources leave out empty files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = spark.createDataFrame([(x.getPath().getName(), x.getLen()) for x in found if x.isFile() and not x.getPath().getName().startswith((".", "_"))], "name string, length bigint")
    return files.withColumn("reason", F.when(~F.col("name").endswith(".jsonl"), "not_jsonl").when(F.lower("name").contains("wiki"), "wiki").when(F.col("length") == 0, "empty"))


def pulled(df: DataFrame, source: str, lang: str, most: int = 500_000) -> DataFrame:
    """text, source, manual, lang of a downloaded set: text or else content, trimmed, none empty, at most so many in order
    of pos. The cap is the feature: a pull is defined by its first documents; its border is found by counts."""
    text = strip(F.coalesce(F.nullif("text", F.lit("")), F.nullif("content", F.lit(""))))
    out = first_in_order(df.withColumn("text", text).where("text <> ''"), "pos", most)
    return out.select("pos", "text", F.lit(source).alias("source"), F.lit(False).alias("manual"), F.lit(lang).alias("lang"))


def shard_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line, value of shards in zstd, gzip or plain form, by their ending. Zstd is no codec of Spark's text sources,
    so shards are read whole by file and decompressed as streams; a shard is one task, as its writer bounds its size."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = io.BytesIO(content)
                stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) if path.endswith(".zst") else gzip.open(raw) if path.endswith(".gz") else raw
                rows: list[tuple[str, int, str]] = []
                for number, line in enumerate(io.TextIOWrapper(stream, "utf-8", errors="replace")):
                    if line.strip():
                        rows.append((path.rpartition("/")[2], number, line.rstrip("\n")))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["file", "line", "value"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "line", "value"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(lines, "file string, line int, value string")


def read_shards(spark: SparkSession, paths: str | list[str], schema: str = DOCUMENT) -> DataFrame:
    """Records of shards, malformed lines left out, with file and line."""
    rows = shard_lines(spark, paths).select("file", "line", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where("r._corrupt_record is null and r is not null").select("file", "line", "r.*").drop("_corrupt_record")


def write(df: DataFrame, path: str, by: list[str] | None = None, records: int | None = None, sort_keys: bool = False, compression: str = "gzip") -> None:
    """JSON lines, `records` to a shard at most, in folders of `by`; Spark's commit makes a half-written result invisible."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    writer = out.write.mode("overwrite").option("compression", compression)
    if records:
        writer = writer.option("maxRecordsPerFile", records)
    (writer.partitionBy(*by) if by else writer).json(path)


def find_shards(spark: SparkSession, folders: list[str], prefix: str = "shard-") -> list[str]:
    """The shards (prefix, .jsonl in the name) of the first folder that has any, in order of their names; an error that
    names all folders if none has."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            found = sorted(x.getPath().toString() for x in system.listStatus(path) if x.isFile() and x.getPath().getName().startswith(prefix) and ".jsonl" in x.getPath().getName())
            if found:
                return found
    raise FileNotFoundError(f"no {prefix}*.jsonl* in any of {', '.join(folders)}")


def write_shards(df: DataFrame, folder: str, size: int = 1000, level: int = 10) -> DataFrame:
    """Writes df, in order of pos, as zstd shards of `size` records, numbered on from those that the folder has; gives
    file, n of what is written. The folder is one that all executors see. A shard is written under another name and renamed,
    so a task run again leaves no half-written one."""
    spark = df.sparkSession
    Path(folder).mkdir(parents=True, exist_ok=True)
    start = len(list(Path(folder).glob("shard-*.jsonl.zst")))
    placed = running_total(df.withColumn("_one", F.lit(1)), "pos", "_one").withColumn("_shard", F.floor(F.col("before") / size) + start)
    rows = placed.select("_shard", "pos", F.to_json(F.struct(*df.columns)).alias("line"))

    def store(part: pd.DataFrame) -> pd.DataFrame:
        import os

        import zstandard

        part = part.sort_values("pos")
        name = f"shard-{part['_shard'].iloc[0]:05d}.jsonl.zst"
        raw = zstandard.ZstdCompressor(level=level).compress(("\n".join(part["line"]) + "\n").encode())
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with open(draft, "wb") as file:
            file.write(raw)
        os.replace(draft, f"{folder}/{name}")
        return pd.DataFrame({"file": [name], "n": [len(part)]})

    written = rows.groupBy("_shard").applyInPandas(store, "file string, n bigint").collect()  # a row for each shard
    return spark.createDataFrame(written, "file string, n bigint")


def write_splits(df: DataFrame, folder: str, sentences: Column) -> None:
    """Writes df by split as JSON lines, and the sentences of the train split as text, one a line."""
    write(df, f"{folder}/splits", by=["split"])
    lines = df.where("split = 'train'").select(F.explode(sentences).alias("value")).where("value <> ''")
    lines.write.mode("overwrite").text(f"{folder}/sentences")


def write_statistics(df: DataFrame, path: str) -> None:
    """A small table of statistics as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a training log in CSV (with a head) or JSON lines, by its ending."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.json(path)


def validations(log: DataFrame) -> DataFrame:
    """The rows with a validation loss."""
    return log.where("val_loss is not null and trim(cast(val_loss as string)) <> ''")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """site, host, root, category, lang of a registry in YAML (a list manual_sites of name, domain, root, category, lang);
    no rows without the file or the YAML library. A site without a category is uncategorised."""
    schema = "site string, host string, root string, category string, lang string"
    try:
        import yaml
    except ImportError:
        return spark.createDataFrame([], schema)
    if not Path(path).exists():
        return spark.createDataFrame([], schema)
    known = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    rows = [(x["name"], x.get("domain"), x.get("root"), x.get("category", "uncategorised"), x.get("lang")) for x in known.get("manual_sites", []) if isinstance(x, dict) and "name" in x]
    return spark.createDataFrame(rows, schema)


def line_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, n of text files, blank lines too."""
    return spark.read.text(paths).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def fingerprints(spark: SparkSession, paths: str | list[str], head: int | None = 1_000_000) -> DataFrame:
    """file, length, sha256 of the first bytes, or of all."""
    files = spark.read.format("binaryFile").load(paths)
    content = F.substring("content", 1, head) if head else F.col("content")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", F.sha2(content, 256).alias("sha256"))
