"""Problem 6: same or near-same records across splits.

Method: edit-distance segment join on words. A text of n words can be within a tenth (of the longer text) of another
only by at most k = n // 9 edits. Evaluation texts are cut into 2 (k + 1) segments, of which the k + 1 that are
rarest among the training texts are kept: k edits leave at least one of any k + 1 segments whole, so every partner
holds one of them, at a place at most k words off. Training texts' substrings are matched with them, and candidates
verified by banded dynamic programming. Keeping the rarest avoids segments (site lines, say) that very many texts share;
of a segment that many training texts hold all the same, these are spread by salt.

Texts become 64-bit hashes of their words once; from there on no text is read or moved, and of the hashes only those of
texts that are candidates. Texts with the same words form a class; classes are joined (p6_classes: pairs of classes;
p6_members: the rows of each), and for p6_found their rows are put in at the end. Substrings pass a bitmap of the
segments, sized by their number up to a bound, before they are shuffled; a fuller bitmap lets more pass and loses nothing.

Case, punctuation, spacing, invisible and look-alike characters are disregarded. Null and empty texts, and texts
without a word, make no pair; rows whose split is neither train nor val or test are left out. Repeated rows of one
row_id give one pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sarit.llm.batches import bitmap_of, mix64, passes
from sarit.llm.leaks import word_hashes
from sarit.plans.arrow import map_text, ragged
from sarit.plans.scale import broadcast_if_small, cut, spread, table

#: Training texts of one segment that one task compares.
SALTED = 2000
#: Pairs whose words are counted at once, and cells that words are counted in.
PAIRS, BINS = 1024, 256
#: Cells of the bands of pairs that are compared at once.
CELLS = 1 << 14
#: Words whose hashes a task handles at once.
WORDS = 1 << 18
TRAIN, EVALUATION = "train", ("val", "test")


def edits(n: int) -> int:
    """Most edits between a text of n words and any partner of at least n words."""
    return n // 9


def cuts(n: int) -> np.ndarray:
    """Where the segments of a text of n words begin, and n."""
    pieces = 2 * (edits(n) + 1)
    return np.arange(pieces + 1) * n // pieces


def segment_lengths(m: int) -> set[int]:
    """Lengths of the segments of all evaluation texts that a training text of m words can be near to."""
    out: set[int] = set()
    for n in range(max(9, m - m // 9 - 1), m + m // 9 + 2):
        out |= {n // (2 * (edits(n) + 1)), -(-n // (2 * (edits(n) + 1)))}
    return out - {0}


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences, most + 1 if it is more: dynamic programming in a band, row by row."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    width = 2 * most + 1
    step = np.arange(width)
    padded = np.concatenate([np.zeros(most + 1, b.dtype), b, np.zeros(2 * most + 2, b.dtype)])
    there = np.concatenate([np.zeros(most + 1, bool), np.ones(len(b), bool), np.zeros(2 * most + 2, bool)])
    far = most + 1
    row = np.where(step >= most, step - most, far)  # row[x]: cost at column i + x - most
    for i, word in enumerate(a, 1):
        window = slice(i, i + width)  # words b[i + x - most - 1]
        same = there[window] & (padded[window] == word)
        cost = row + ~same
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        column = i + step - most
        cost = np.where((column < 0) | (column > len(b)), far, cost)
        if 0 <= most - i < width:
            cost[most - i] = i
        row = np.minimum(np.minimum.accumulate(cost - step) + step, far)
        if row.min() > most:
            return far
    return int(row[len(b) - len(a) + most])


def distances(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """distance() of many pairs at once, whose bands stand in the rows of one matrix."""
    n, width, far = len(a), 2 * most + 1, most + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    step = np.arange(width)
    left, right = np.zeros((n, la.max(initial=0)), np.int64), np.zeros((n, lb.max(initial=0) + la.max(initial=0) + 3 * most + 3), np.int64)
    there = np.zeros(right.shape, bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)] = x
        right[i, most + 1 : most + 1 + len(y)] = y
        there[i, most + 1 : most + 1 + len(y)] = True
    row = np.repeat(np.where(step >= most, step - most, far)[None], n, 0)
    out = np.where(la == 0, np.minimum(lb, far), far)
    end = lb - la + most
    for i in range(1, left.shape[1] + 1):
        window = slice(i, i + width)
        cost = row + ~(there[:, window] & (right[:, window] == left[:, i - 1 : i]))
        cost[:, :-1] = np.minimum(cost[:, :-1], row[:, 1:] + 1)
        column = i + step - most
        cost[(column < 0)[None] | (column[None] > lb[:, None])] = far
        if 0 <= most - i < width:
            cost[:, most - i] = i
        row = np.minimum(np.minimum.accumulate(cost - step, axis=1) + step, far)
        done = np.flatnonzero((la == i) & (end >= 0) & (end < width))
        out[done] = row[done, end[done]]
    return out


def _windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place on, in the order given."""
    n = len(hashes) - length + 1
    out = np.full(max(n, 0), length, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length if n > 0 else 0):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return out


def _worded(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """row_id, evaluation, class (a hash of all words) and words of the texts that have any."""
    hashes, sizes = word_hashes(batch.column("text").to_pylist())
    ends = np.cumsum(sizes)
    keep = np.flatnonzero(sizes)
    take = pa.array(keep)
    names = [xxhash.xxh3_128_digest(hashes[ends[i] - sizes[i] : ends[i]].tobytes()) for i in keep.tolist()]
    return pa.RecordBatch.from_arrays([batch.column("row_id").take(take), batch.column("evaluation").take(take), pa.array(names, pa.binary()), ragged(hashes.view(np.int64), sizes[keep], pa.int64())], ["row_id", "evaluation", "class", "words"])


def _parts(batch: pa.RecordBatch):
    """Slices of a batch of about WORDS words each: row_id, all words, words of each row. A longer text comes alone."""
    column = batch.column("words")
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, "right")))
        yield batch.column("row_id").slice(start, stop - start), np.asarray(column.slice(start, stop - start).flatten()).view(np.uint64), sizes[start:stop]
        start = stop


def _segments(batches):
    """row_id, n, hash, place of all segments of texts of nine words or more; shorter ones have same words or none."""
    for batch in batches:
        for row_id, hashes, sizes in _parts(batch):
            rows, lengths, keys, places = [], [], [], []
            start = 0
            for i, n in enumerate(sizes.tolist()):
                words, start = hashes[start : start + n], start + n
                if n < 9:
                    continue
                at = cuts(n)
                size = np.diff(at)
                for length in np.unique(size).tolist():
                    found = at[:-1][size == length]
                    keys.append(_windows(words, length)[found])
                    places.append(found)
                    rows.append(np.full(len(found), i))
                    lengths.append(np.full(len(found), n))
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([row_id.take(row), pa.array(np.concatenate(lengths), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places), pa.int32())], ["row_id", "n", "hash", "place"])


def _substrings(shared: object, count: bool):
    """Of training texts the substrings in the bitmap: hash and number in the chunk, or row_id, m, hash, place."""

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            for row_id, hashes, sizes in _parts(batch):
                owner = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.cumsum(sizes) - sizes
                by_size = {m: segment_lengths(m) for m in set(sizes.tolist())}
                keys, at = [], []
                for length in sorted(set().union(*by_size.values())) if by_size else ():
                    texts = np.array([length in by_size[m] and m >= length for m in sizes.tolist()])
                    key = _windows(hashes, length)
                    if not len(key):
                        continue
                    place = np.flatnonzero(texts[owner[: len(key)]] & (owner[: len(key)] == owner[length - 1 :]))
                    place = place[passes(bitmap, key[place])]
                    keys.append(key[place])
                    at.append(place)
                if not keys or not sum(map(len, keys)):
                    continue
                key, place = np.concatenate(keys), np.concatenate(at)
                if count:
                    known, times = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(times, pa.int64())], ["hash", "n"])
                    continue
                row = owner[place]
                yield pa.RecordBatch.from_arrays([row_id.take(pa.array(row)), pa.array(sizes[row], pa.int32()), pa.array(key.view(np.int64)), pa.array(place - starts[row], pa.int32())], ["row_id", "m", "hash", "place"])

    return run


def bound(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """A lower bound of twice the edit distance of each pair of word sequences: an edit changes the counts of words, here of
    words by the last bits of their hashes, by two at most."""
    counts = np.zeros((len(left), BINS), np.int32)
    for column, sign in ((left, 1), (right, -1)):
        sizes = np.asarray(column.value_lengths()).astype(np.int64)
        words = np.asarray(column.flatten()).view(np.uint64)
        cell = np.repeat(np.arange(len(column)), sizes) * BINS + (words % np.uint64(BINS)).astype(np.int64)
        counts += sign * np.bincount(cell, minlength=counts.size).astype(np.int32).reshape(counts.shape)
    return np.abs(counts).sum(1)


def _verify(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, PAIRS):
            part = batch.slice(start, PAIRS)
            left, right = part.column("a"), part.column("b")
            longest = np.maximum(np.asarray(left.value_lengths()), np.asarray(right.value_lengths())).astype(np.int64)
            maybe = bound(left, right) <= 2 * (longest // 10)
            if not maybe.any():
                continue
            left, right = ([np.asarray(x.slice(i, 1).flatten()) for i in range(part.num_rows)] for x in (left, right))
            keep: list[int] = []
            for most in np.unique(longest[maybe] // 10).tolist():
                same = np.flatnonzero(maybe & (longest // 10 == most))
                for i in range(0, len(same), max(1, CELLS // (2 * most + 1))):
                    some = same[i : i + max(1, CELLS // (2 * most + 1))]
                    keep += some[distances([left[k] for k in some], [right[k] for k in some], most) <= most].tolist()
            if keep:
                yield part.select(["of_evaluation", "of_train"]).take(pa.array(sorted(keep), pa.int64()))


class Overlaps:
    """rows: row_id, evaluation, class of the rows that take part; pairs: of_evaluation, of_train of the classes that are
    near or the same."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        documents = spread(table(spark, sf_dir, "split_docs", "row_id", "text", "split")).where(F.col("split").isin(TRAIN, *EVALUATION) & F.col("text").isNotNull() & F.col("row_id").isNotNull())
        documents = documents.select("row_id", "text", (F.col("split") != TRAIN).alias("evaluation"))
        worded = cut(map_text(documents, _worded, "row_id bigint, evaluation boolean, class binary, words array<bigint>"))
        self.rows = worded.select("row_id", "evaluation", "class").distinct()
        first = cut(self.rows.groupBy("class", "evaluation").agg(F.min("row_id").alias("row_id")))
        evaluation, train = worded.where("evaluation").select("row_id", "words"), worded.where("not evaluation").select("row_id", "words")
        segments = evaluation.mapInArrow(_segments, "row_id bigint, n int, hash bigint, place int").distinct()
        segments = cut(segments.join(first.where("evaluation").select("row_id"), "row_id", "left_semi"))
        counts = train.mapInArrow(_substrings(spark.sparkContext.broadcast(bitmap_of(segments)), True), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("times"))
        rarest = F.row_number().over(Window.partitionBy("row_id").orderBy(F.coalesce("times", F.lit(0)), "place"))
        chosen = segments.join(counts, "hash", "left").withColumn("rank", rarest).where((F.col("rank") <= F.floor(F.col("n") / 9) + 1) & F.col("times").isNotNull())
        chosen = cut(chosen.select(F.col("row_id").alias("evaluation_id"), "n", "hash", F.col("place").alias("at"), F.ceil(F.col("times") / SALTED).cast("int").alias("salts")))
        substrings = train.mapInArrow(_substrings(spark.sparkContext.broadcast(bitmap_of(chosen)), False), "row_id bigint, m int, hash bigint, place int")
        substrings = substrings.join(first.where("not evaluation").select("row_id"), "row_id", "left_semi").withColumnRenamed("row_id", "train_id")
        hot = cut(chosen.where("salts > 1").select("hash", "salts").distinct())
        salted = substrings.join(broadcast_if_small(hot), "hash", "left").withColumn("salt", F.pmod(F.xxhash64("train_id"), F.coalesce("salts", F.lit(1)).cast("bigint")).cast("int")).drop("salts")
        asked = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        near = (F.abs(F.col("place") - F.col("at")) <= F.floor(F.col("n") / 9)) & (F.abs(F.col("m") - F.col("n")) <= F.floor(F.greatest("m", "n") / 10))
        candidates = cut(asked.join(salted, ["hash", "salt"]).where(near).select("evaluation_id", "train_id").distinct())
        of = lambda side, key, name, words: side.join(broadcast_if_small(cut(candidates.select(F.col(key).alias("row_id")).distinct())), "row_id", "left_semi").dropDuplicates(["row_id"]).select(F.col("row_id").alias(key), F.col("class").alias(name), F.col("words").alias(words))
        both = candidates.join(of(worded.where("evaluation"), "evaluation_id", "of_evaluation", "a"), "evaluation_id").join(of(worded.where("not evaluation"), "train_id", "of_train", "b"), "train_id")
        alike = both.select("of_evaluation", "of_train", "a", "b").mapInArrow(_verify, "of_evaluation binary, of_train binary")
        same = first.groupBy("class").agg(F.count("*").alias("n")).where("n = 2").select(F.col("class").alias("of_evaluation"), F.col("class").alias("of_train"))
        self.pairs = cut(alike.unionByName(same).distinct())

    def members(self, evaluation: bool) -> DataFrame:
        side, name, key = ("evaluation", "of_evaluation", "evaluation_id") if evaluation else ("not evaluation", "of_train", "train_id")
        return self.rows.where(side).select(F.col("class").alias(name), F.col("row_id").alias(key))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train_id, evaluation_id of all pairs of rows."""
    found = Overlaps(spark, sf_dir)
    return found.pairs.join(found.members(True), "of_evaluation").join(found.members(False), "of_train").select("train_id", "evaluation_id").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: row_a, row_b."""
    return pairs(spark, sf_dir).select(F.least("train_id", "evaluation_id").alias("row_a"), F.greatest("train_id", "evaluation_id").alias("row_b")).distinct()


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_classes: of_evaluation, of_train, n_evaluation, n_train: pairs of classes of rows with the same words, a class named
    by the hash of these, and the rows that each has on its side."""
    found = Overlaps(spark, sf_dir)
    sizes = found.rows.groupBy("class", "evaluation").agg(F.count("*").alias("n"))
    one = sizes.where("evaluation").select(F.col("class").alias("of_evaluation"), F.col("n").alias("n_evaluation"))
    two = sizes.where("not evaluation").select(F.col("class").alias("of_train"), F.col("n").alias("n_train"))
    return found.pairs.join(one, "of_evaluation").join(two, "of_train").select(F.hex("of_evaluation").alias("of_evaluation"), F.hex("of_train").alias("of_train"), "n_evaluation", "n_train")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_members: row_id, class, n_links of every row with words: its links lead to rows on the other side, copies counted."""
    found = Overlaps(spark, sf_dir)
    sizes = found.rows.groupBy("class", "evaluation").agg(F.count("*").alias("n"))
    both = found.pairs.join(sizes.where("not evaluation").select(F.col("class").alias("of_train"), "n"), "of_train").groupBy(F.col("of_evaluation").alias("class")).agg(F.sum("n").alias("links")).withColumn("evaluation", F.lit(True))
    back = found.pairs.join(sizes.where("evaluation").select(F.col("class").alias("of_evaluation"), "n"), "of_evaluation").groupBy(F.col("of_train").alias("class")).agg(F.sum("n").alias("links")).withColumn("evaluation", F.lit(False))
    return found.rows.join(both.unionByName(back), ["class", "evaluation"], "left").select("row_id", F.hex("class").alias("class"), F.coalesce("links", F.lit(0)).alias("n_links"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_report: split, source, n_rows, n_overlapping (rows with a partner in train), n_pairs of val and test; counted by
    classes, no pairs of rows are made."""
    found = Overlaps(spark, sf_dir)
    sizes = found.rows.where("not evaluation").groupBy(F.col("class").alias("of_train")).agg(F.count("*").alias("n"))
    links = found.pairs.join(sizes, "of_train").groupBy("of_evaluation").agg(F.sum("n").alias("n"))
    counts = found.members(True).join(links, "of_evaluation").groupBy("evaluation_id").agg(F.sum("n").alias("n"))
    rows = table(spark, sf_dir, "split_docs", "row_id", "split", "source").where(F.col("split").isin(*EVALUATION))
    out = rows.join(counts, rows["row_id"] == counts["evaluation_id"], "left")
    return out.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
