"""Token files: a stream of little-endian 16-bit ids without header, and back."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.operators.ngram import running_total

#: About how many tokens a file holds.
FILE = 50_000_000


def read(spark: SparkSession, paths: str | list[str], block: int = 65_536) -> DataFrame:
    """file, block, ids: each file in blocks of so many tokens; a file comes whole to one task, as its writer bounds it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                ids = np.frombuffer(content, "<u2").astype(np.int32)
                for i in range(0, len(ids), block):
                    yield pd.DataFrame({"file": [path.rpartition("/")[2]], "block": [i // block], "ids": [ids[i : i + block]]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(cut, "file string, block int, ids array<int>")


def content(tokens: DataFrame, most: int = 65_535) -> DataFrame:
    """part, content, n_tokens: the stream of rows (part, pos, ids) of each part as bytes, in order of pos.

    part bounds a file's size and is chosen by the caller. An id over `most` is an error."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.asarray(x, np.int64) for x in rows.sort_values("pos")["ids"]] or [np.zeros(0, np.int64)])
        if len(ids) and ids.max() > most:
            raise ValueError(f"token id {ids.max()} doesn't fit 16 bits")
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "content": [ids.astype("<u2").tobytes()], "n_tokens": [len(ids)]})

    return tokens.select(F.col("part").cast("bigint").alias("part"), "pos", "ids").groupBy("part").applyInPandas(join, "part bigint, content binary, n_tokens bigint")


def write(tokens: DataFrame, folder: str, meta: dict) -> dict:
    """Writes the stream of rows (split, pos, ids) of each split as files of 16-bit ids, a part for each FILE tokens or so,
    and meta.json with the given entries, the tokens of each split and its files in order. The folder is one that all
    executors see; a part is written under another name and renamed."""
    sized = tokens.withColumn("_n", F.size("ids").cast("bigint"))
    Path(folder).mkdir(parents=True, exist_ok=True)
    splits = {}
    for row in sized.groupBy("split").agg(F.sum("_n").alias("n")).orderBy("split").collect():  # a row for each split
        rows = running_total(sized.where(F.col("split") == row.split).drop("split"), "pos", "_n")
        parts = content(rows.select(F.floor(F.col("before") / FILE).alias("part"), "pos", "ids"))
        name = f"{folder}/{row.split}"

        def store(batches: Iterator[pd.DataFrame], name=name) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part, raw in zip(batch["part"], batch["content"], strict=True):
                    draft = f"{name}-{part:05d}.{uuid.uuid4().hex}"
                    Path(draft).write_bytes(raw)
                    os.replace(draft, f"{name}-{part:05d}.bin")
                yield pd.DataFrame({"file": [f"{Path(name).name}-{p:05d}.bin" for p in batch["part"]], "n": batch["n_tokens"]})

        files = parts.mapInPandas(store, "file string, n bigint").orderBy("file").collect()  # a row for each file
        splits[row.split] = {"tokens": row.n, "files": [f.file for f in files], "dtype": "uint16"}
    whole = {**meta, "splits": splits}
    Path(folder, "meta.json").write_text(json.dumps(whole, ensure_ascii=False, indent=2), "utf-8")
    return whole
