"""Helpers that keep plans safe on large clusters: lineage cuts, size-checked broadcasts, input spreading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that may be broadcast, and most bytes; checked against the real table.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir). Where it is unset a local master gets a folder of its own,
    deleted at the end, as in tests; a cluster gets an error, since its executors share no local folder."""
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="sarit-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def posix_folder(spark: SparkSession) -> str:
    """The same as a path of the file system that all executors mount, for sinks that write files by themselves."""
    folder = shared_folder(spark)
    path = folder.removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"{folder} isn't a mounted folder")
    return "/" + path.lstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table to the shared folder: for texts, which take less there than in a checkpoint and of which
    later steps read only the columns that they need."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows and BROADCAST_BYTES bytes, else df as it is, joined by a
    shuffle.

    df should be cheap to count: a checkpoint or a small table."""
    size = F.octet_length(F.to_json(F.struct("*")))
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and held <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """df, a table as read, over as many partitions as there are cores, if its files give fewer (a single small file, say)."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of the folder, with only the given columns if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers: they find it by PYTHONPATH, else Spark sends it to them."""
    root = Path(__file__).resolve().parent.parent.parent
    application = spark.sparkContext.applicationId
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if application in _SHIPPED or str(root) in paths:
        return
    folder = tempfile.mkdtemp(prefix="sarit-code-")  # on the driver only, which serves the archive
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = __package__.partition(".")[0]
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", root, name))
    _SHIPPED.add(application)
