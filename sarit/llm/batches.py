"""Index arithmetic, mixing of hashes, and bitmaps of hashes for the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most and fewest bits of a bitmap, and bits for a hash; at most 128 MB go to the executors. A fuller bitmap lets more pass.
BITS, FEWEST, EACH = 1 << 30, 1 << 16, 16


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ..., start + length - 1 of every pair, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(starts - firsts, lengths) + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input changes every bit of the output about half of the time."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a bitmap of so many bits."""
    mask = np.uint64(bits - 1)
    return key & mask, (key >> np.uint64(32)) & mask


def bitmap_of(segments: DataFrame) -> np.ndarray:
    """The bitmap of the column hash; made by the executors, word by word of 64 bits, and joined by or."""
    bits = FEWEST
    n = segments.count()
    while bits < min(BITS, EACH * n):
        bits *= 2

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column("hash")).view(np.uint64)
            there = np.unique(np.concatenate(_places(keys, bits)))
            word = (there >> np.uint64(6)).astype(np.int64)
            start = np.flatnonzero(np.diff(word, prepend=-1))
            value = np.bitwise_or.reduceat(np.uint64(1) << (there & np.uint64(63)), start) if len(start) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[start]), pa.array(value.view(np.int64))], ["word", "bits"])

    rows = segments.select("hash").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits >> 6, np.uint64)
    out[np.asarray(rows.column("word").combine_chunks())] = np.asarray(rows.column("bits").combine_chunks()).view(np.uint64)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _places(keys, len(bitmap) << 6)
    return ((bitmap[(a >> np.uint64(6)).astype(np.int64)] >> (a & np.uint64(63))) & (bitmap[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
