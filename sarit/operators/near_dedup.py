"""Near duplicates: one-permutation MinHash in bands, candidates verified by the exact similarity of their shingles.

A text's shingles are hashed once and fall into as many bins as a signature has places; a place is the least hash of its
bin. Empty bins take over another bin of the same text, found along a sequence that is the same for all texts, so that a
place of two texts agrees with a chance equal to their similarity. The work for a text doesn't grow with the signature.

Texts with the same shingles are one from there on, so copies cost no pairs. The others meet in the buckets of their
bands. In each bucket all are first compared with the one of least pos; what isn't near to it is compared with all
others of the bucket, spread by salt, so a bucket of one large class costs its size, not its square, and no task has to
take a whole bucket. Null texts take no part; texts without words are copies of each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarit.functions.hashing import shingles, stirred
from sarit.plans.arrow import map_text, ragged
from sarit.plans.scale import cut

#: Members of a bucket that one task compares with others.
SALTED = 2000
#: Links of a component that one task decides by itself; larger ones are decided by rounds over tables.
LINKS = 100_000


@dataclass(frozen=True)
class NearDupParams:
    """threshold: least similarity of a pair; places: length of the signature; shingle: words of a shingle; recall: least
    chance that a pair at the threshold shares a band."""

    threshold: float = 0.8
    places: int = 128
    shingle: int = 5
    recall: float = 0.9999


def geometry(params: NearDupParams) -> tuple[int, int]:
    """Bands and rows: the most rows, which meet the fewest unlike pairs, at which enough bands for the recall fit."""
    for rows in range(params.places, 1, -1):
        bands = math.ceil(math.log1p(-params.recall) / math.log1p(-(params.threshold**rows)))
        if bands * rows <= params.places:
            return bands, rows
    return params.places, 1


class Signer:
    """Shingles, signatures and band keys of many texts at once."""

    TRIES = 96

    def __init__(self, params: NearDupParams):
        self.params = params
        self.bands, self.rows = geometry(params)
        self.detours = np.random.default_rng(params.places).integers(0, params.places, (self.TRIES, params.places))

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return shingles(texts, self.params.shingle)

    def signatures(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row for each text; all ones for a text without shingles."""
        n, places = len(sizes), self.params.places
        none = np.uint64((1 << 64) - 1)
        mixed = stirred(values ^ np.uint64(places))
        cell = np.repeat(np.arange(n), sizes) * places + (mixed >> np.uint64(32)).astype(np.int64) % places
        order = np.lexsort((mixed, cell))
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        out = np.full(n * places, none)
        out[cell[order][first]] = mixed[order][first]
        out = out.reshape(n, places)
        full = out != none
        rows = np.flatnonzero(full.any(1) & ~full.all(1))
        part, there = out[rows], full[rows]
        open_ = ~there
        for detour in self.detours:
            take = open_ & there[:, detour]
            part[take] = out[rows][:, detour][take]
            open_ &= ~take
            if not open_.any():
                break
        if open_.any():  # what no detour reached takes over the next full bin to the right
            place = np.where(there, np.arange(places), 2 * places)
            after = np.minimum.accumulate(np.concatenate([place, place + places], 1)[:, ::-1], 1)[:, ::-1][:, :places]
            at = np.nonzero(open_)
            part[at] = out[rows[at[0]], after[at] % places]
        out[rows] = part
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """The key of each band of each text, which depends on the band's number too."""
        used = signatures[:, : self.bands * self.rows].reshape(len(signatures), self.bands, self.rows)
        key = np.broadcast_to(stirred(np.arange(1, self.bands + 1, dtype=np.uint64)), used.shape[:2])
        for r in range(self.rows):
            key = stirred(key + used[:, :, r])
        return key.view(np.int64)


@cache
def _signer(params: NearDupParams) -> Signer:
    """One for each Python worker."""
    return Signer(params)


def _signed(df: DataFrame, params: NearDupParams) -> DataFrame:
    """pos, whole, keys of the documents with a text; whole is a hash of all shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        signer = _signer(params)
        values, sizes = signer.shingles(batch.column("text").to_pylist())
        ends = np.cumsum(sizes)
        whole = [xxhash.xxh3_128_digest(values[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        keys = signer.keys(signer.signatures(values, sizes))
        return pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(whole, pa.binary()), ragged(keys.ravel(), np.full(len(sizes), signer.bands), pa.int64())], ["pos", "whole", "keys"])

    return map_text(df.where("text is not null").select("pos", "text"), run, "pos bigint, whole binary, keys array<bigint>")


def _shingled(df: DataFrame, params: NearDupParams) -> DataFrame:
    """pos, shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, sizes = shingles(batch.column("text").to_pylist(), params.shingle)
        return pa.RecordBatch.from_arrays([batch.column("pos"), ragged(values.view(np.int64), sizes, pa.int64())], ["pos", "shingles"])

    return map_text(df.select("pos", "text"), run, "pos bigint, shingles array<bigint>")


def _near(met: DataFrame, shingled: DataFrame, params: NearDupParams) -> DataFrame:
    """low, high of the met pairs whose shingles agree to the threshold."""
    both = met.join(shingled.select(F.col("pos").alias("low"), F.col("shingles").alias("a")), "low").join(shingled.select(F.col("pos").alias("high"), F.col("shingles").alias("b")), "high")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= params.threshold * (F.size("a") + F.size("b") - shared) - 1e-9).select("low", "high")


def _same(signed: DataFrame) -> DataFrame:
    """pos, first of all documents: the first with the same shingles."""
    firsts = signed.groupBy("whole").agg(F.min("pos").alias("first"))
    return cut(signed.select("pos", "whole").join(firsts, "whole").select("pos", "first"))


def bucket_pairs(keys: DataFrame, shingled: DataFrame, params: NearDupParams = NearDupParams(), every: bool = False) -> DataFrame:
    """low, high of the near pairs of rows (pos, key) that share a key, by the shingles of (pos, shingles): all of them, or
    (every false) enough to link all that are linked. keys is a checkpoint; a row of shingles for each pos of it."""
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("pos").alias("leader")).where("n > 1")
    keys = keys.join(buckets, "key").where("pos > leader")
    linked = cut(_near(keys.select(F.col("leader").alias("low"), F.col("pos").alias("high")).distinct(), shingled, params))
    rest = keys.where("n > 2")
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    left = rest if every else rest.join(linked.select(F.col("low").alias("leader"), F.col("high").alias("pos")), ["leader", "pos"], "left_anti")
    left = left.select("key", F.col("pos").alias("one"), F.pmod(F.xxhash64("pos"), salts.cast("bigint")).cast("int").alias("salt"))
    right = rest.select("key", F.col("pos").alias("other"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = left.join(right, ["key", "salt"]).where("one <> other").select(F.least("one", "other").alias("low"), F.greatest("one", "other").alias("high")).distinct()
    met = met.join(linked, ["low", "high"], "left_anti")
    return cut(linked.unionByName(_near(met, shingled, params)).distinct())


def verified_pairs(df: DataFrame, params: NearDupParams = NearDupParams(), every: bool = False) -> tuple[DataFrame, DataFrame]:
    """pos, first of all documents with a text: the first with the same shingles; and the bucket_pairs() of such firsts."""
    signed = cut(_signed(df, params))
    same = _same(signed)
    keys = signed.join(same.where("pos = first").select("pos"), "pos", "left_semi").select("pos", F.explode("keys").alias("key"))
    keys = cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi"))
    shingled = cut(_shingled(df.where("text is not null").join(keys.select("pos").distinct(), "pos", "left_semi"), params))
    return same, bucket_pairs(keys, shingled, params, every)


def components(edges: DataFrame) -> DataFrame:
    """pos, class of the ends of edges (low, high): the least pos that they lead to.

    A round takes the least class among the neighbours and then that class's own; rounds go on while any changes, their
    number grows with the logarithm of the longest path."""
    both = cut(edges.select(F.col("low").alias("pos"), F.col("high").alias("other")).unionByName(edges.select(F.col("high").alias("pos"), F.col("low").alias("other"))))
    found = cut(both.groupBy("pos").agg(F.least("pos", F.min("other")).alias("class")))
    while True:
        near = both.join(found.select(F.col("pos").alias("other"), "class"), "other").groupBy("pos").agg(F.min("class").alias("near"))
        one = found.join(near, "pos").select("pos", F.col("class").alias("before"), F.least("class", "near").alias("class"))
        two = found.select(F.col("pos").alias("class"), F.col("class").alias("further"))
        after = cut(one.join(two, "class").select("pos", "before", F.least("class", "further").alias("class")))
        found = after.select("pos", "class")
        if after.where("before <> class").isEmpty():
            return found


def classes(df: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """pos, class of all documents with a text: the least pos that near pairs lead to."""
    same, pairs = verified_pairs(df, params)
    return same.join(components(pairs).withColumnRenamed("pos", "first"), "first", "left").select("pos", F.coalesce("class", "first").alias("class"))


def class_duplicates(df: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """pos, canonical of the documents that aren't the first of their class: its id, which is its least pos."""
    return classes(df, params).where("class < pos").select("pos", F.col("class").alias("canonical"))


def first_of_classes(df: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """df with the first document of each class; null texts stay."""
    return df.join(class_duplicates(df, params).select("pos"), "pos", "left_anti")


def marked(df: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """pos, canonical of the documents that are near to one of lower pos, dropped or not: the least such."""
    same, pairs = verified_pairs(df, params, every=True)
    firsts = pairs.groupBy(F.col("high").alias("first")).agg(F.min("low").alias("near"))
    return same.join(firsts, "first", "left").select("pos", F.coalesce("near", "first").alias("canonical")).where("canonical < pos")


def _kept(pairs: pd.DataFrame) -> pd.DataFrame:
    """pos, kept of the ends of a component's pairs, in order of pos."""
    near: dict[int, list[int]] = {}
    for low, high in zip(pairs["low"], pairs["high"], strict=True):
        near.setdefault(low, [])
        near.setdefault(high, []).append(low)
    kept: dict[int, bool] = {}
    for pos in sorted(near):
        kept[pos] = not any(kept[other] for other in near[pos])
    return pd.DataFrame({"pos": list(kept), "kept": list(kept.values())})


def chosen(pairs: DataFrame, most: int = LINKS) -> DataFrame:
    """pos, kept of the ends of pairs (low, high): dropped only if near to a kept one of lower pos.

    Components of at most `most` pairs are decided in one task each. Larger ones go by rounds, each of which keeps what
    has no undecided neighbour of lower pos and drops the neighbours of what is kept."""
    class_of = components(pairs).select(F.col("pos").alias("low"), "class")
    known = cut(pairs.join(class_of, "low"))
    big = known.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > most).select("class")
    open_ = cut(known.join(big, "class", "left_semi").select("low", "high"))
    out = known.join(big, "class", "left_anti").groupBy("class").applyInPandas(_kept, "pos bigint, kept boolean")
    undecided = cut(open_.select(F.explode(F.array("low", "high")).alias("pos")).distinct())
    while not undecided.isEmpty():
        kept = cut(undecided.join(open_.select(F.col("high").alias("pos")), "pos", "left_anti"))
        dropped = cut(open_.join(kept.select(F.col("pos").alias("low")), "low", "left_semi").select(F.col("high").alias("pos")).distinct())
        out = out.unionByName(kept.withColumn("kept", F.lit(True))).unionByName(dropped.withColumn("kept", F.lit(False)))
        done = kept.unionByName(dropped)
        undecided = cut(undecided.join(done, "pos", "left_anti"))
        open_ = cut(open_.join(done.select(F.col("pos").alias("low")), "low", "left_anti").join(done.select(F.col("pos").alias("high")), "high", "left_anti").select("low", "high"))
    return out


def greedy(df: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """pos, kept of all documents with a text: dropped only if near to a kept one of lower pos. What a copy is near to,
    the first of the copies is near to as well, so copies are never kept."""
    same, pairs = verified_pairs(df, params, every=True)
    decided = cut(chosen(pairs))
    firsts = same.where("pos = first").select("pos").join(decided, "pos", "left").select("pos", F.coalesce("kept", F.lit(True)).alias("kept"))
    return firsts.unionByName(same.where("pos > first").select("pos", F.lit(False).alias("kept")))
