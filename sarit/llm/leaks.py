"""Problem 9: evaluation texts leaking into training text.

Method: every item is cut into passages of twelve consecutive words (the whole item if it is shorter). Windows of a
passage's size slide over each document; a window's SimHash is the sign of the summed word vectors. Fingerprints are
split into BLOCKS blocks; two that differ in fewer bits than there are blocks agree in a whole block, so looking each
block up finds every pair within the radius. Candidates are verified exactly: p9_found keeps those whose word
sequences are the same.

p9_near has these and the edited copies: windows of the whole item's size (a shorter document whole) whose words,
each weighing as often as it occurs, agree with the item's to SIMILAR or more. A window reaches that only with at
least 2 SIMILAR / (1 + SIMILAR) of its words among the item's, which running sums tell of every window; those that
have so many are verified, so nothing is lost to a radius.

Words are compared without case, punctuation, spacing, line breaks, invisible and look-alike characters. Null, empty
and wordless texts and items give nothing. An item or a document that occurs twice is reported once. The items go to
the executors in blocks of at most WINDOWS passages, so that memory is bounded however many items there are; each
block is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.llm.batches import mix64, spans
from sarit.llm.lookalike import word_texts
from sarit.plans.arrow import map_text, ragged
from sarit.plans.scale import spread, table

#: Words of a passage.
PASSAGE = 12
#: Bits of a block; their sum is the fingerprint's 64. Radius: one bit less than there are blocks.
BLOCKS = (22, 21, 21)
#: Most passages that are looked up in one pass over the documents.
WINDOWS = 300_000
#: Words whose windows are looked up at once.
BLOCK_WORDS = 1 << 17
#: The similarity of words that p9_near asks for.
SIMILAR = 0.8
#: Windows that are verified at once.
VERIFIED = 4096


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each."""
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(word_texts(texts), pa.string())))
    flat = words.flatten().dictionary_encode()
    sizes = np.asarray(pc.list_value_length(words)).astype(np.int64)
    known = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in flat.dictionary.to_pylist()], np.uint64)
    hashes = known[np.asarray(flat.indices)] if len(known) else np.zeros(0, np.uint64)
    if len(known) and (known == 0).any():  # a text without words splits into one empty string
        rows = np.repeat(np.arange(len(sizes)), sizes)
        real = hashes != 0
        sizes = np.bincount(rows[real], minlength=len(sizes)).astype(np.int64)
        hashes = hashes[real]
    return hashes, sizes


def fingerprints(hashes: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """SimHash of the window of n words that starts at each word, for each n; the vectors are summed once."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    bits = np.unpackbits(mix64(distinct).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1
    sums = np.zeros((len(hashes) + 1, 64), np.int16)
    np.cumsum(bits[inverse], axis=0, dtype=np.int16, out=sums[1:])  # wraps; differences of up to 2**15 are right
    return {n: np.packbits((sums[n:] - sums[:-n]) > 0, axis=1).view(np.uint64).ravel() for n in sizes if len(hashes) >= n}


def passage_prints(words: np.ndarray) -> np.ndarray:
    """SimHash of passages, one in each row of word hashes."""
    distinct, inverse = np.unique(words, return_inverse=True)
    bits = np.unpackbits(mix64(distinct).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1
    inverse = inverse.reshape(words.shape)
    out = []
    for start in range(0, len(words), 4096):
        sums = bits[inverse[start : start + 4096]].sum(1, dtype=np.int32)
        out.append(np.packbits(sums > 0, axis=1).view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def blocks(prints: np.ndarray) -> list[np.ndarray]:
    """The value of each block of each fingerprint."""
    out, shift = [], 0
    for width in BLOCKS:
        out.append(((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    return out


class Passages:
    """The items' passages of one size, with an index by block."""

    def __init__(self, n: int, words: np.ndarray, items: np.ndarray):
        self.n, self.words, self.items = n, words, items  # words: one row of n hashes for each passage
        self.prints = passage_prints(words)
        self.index = []
        for width, block in zip(BLOCKS, blocks(self.prints), strict=True):
            order = np.argsort(block, kind="stable")
            seen = np.zeros(1 << width, bool)
            seen[block] = True
            self.index.append((seen, block[order], order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, passage) within the radius, each once for each block in which they agree."""
        at, of = [], []
        for (seen, values, order), block in zip(self.index, blocks(prints), strict=True):
            window = np.flatnonzero(seen[block])
            low, high = np.searchsorted(values, block[window], "left"), np.searchsorted(values, block[window], "right")
            passage = order[spans(low, high - low)]
            window = np.repeat(window, high - low)
            near = np.bitwise_count(prints[window] ^ self.prints[passage]) < len(BLOCKS)
            at.append(window[near])
            of.append(passage[near])
        return np.concatenate(at), np.concatenate(of)


def _candidates(hashes: np.ndarray, passages: dict[int, Passages]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, windows and passages of all candidates, in blocks of BLOCK_WORDS words that overlap by a window."""
    longest = max(passages)
    for start in range(0, len(hashes), BLOCK_WORDS):
        for n, prints in fingerprints(hashes[start : start + BLOCK_WORDS + longest - 1], tuple(passages)).items():
            window, passage = passages[n].candidates(prints[:BLOCK_WORDS])
            yield n, window + start, passage


def similarities(windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of lesser over sum of greater weights of the words of each window (a row) and of an item; a word weighs as
    often as it occurs. Words are places in the item's counts, the number of these for a word it doesn't have."""
    rows, n = windows.shape
    kinds = len(counts)
    there = np.bincount((np.arange(rows)[:, None] * (kinds + 1) + windows).ravel(), minlength=rows * (kinds + 1)).reshape(rows, kinds + 1)
    shared = np.minimum(there[:, :kinds], counts).sum(1)
    return shared / (n + counts.sum() - shared)


class Items:
    """Whole items as distinct words and their counts."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.items = [item for item, _ in rows]
        self.sizes = [len(words) for _, words in rows]
        self.kinds = [np.unique(words, return_counts=True) for _, words in rows]

    def near(self, hashes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Row, item and best similarity of all texts with a window that is similar enough."""
        known, ids = np.unique(hashes, return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros(len(hashes) + 1, np.int32)
        for item, n, (words, counts) in zip(self.items, self.sizes, self.kinds, strict=True):
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            there = known[at] == words
            if counts[there].sum() < SIMILAR * n:  # no window holds more of the item than all texts do
                continue
            places = np.full(len(known), len(words), np.int32)
            places[at[there]] = np.flatnonzero(there)
            np.cumsum((places < len(words))[ids], out=sums[1:])
            best: dict[int, float] = {}
            if len(hashes) >= n:
                window = np.flatnonzero((sums[n:] - sums[:-n]) * (1 + SIMILAR) >= 2 * SIMILAR * n - 1e-9)
                window = window[owner[window] == owner[window + n - 1]]
                for i in range(0, len(window), VERIFIED):
                    part = window[i : i + VERIFIED]
                    found = similarities(places[ids[part[:, None] + np.arange(n)]], counts)
                    for w in np.flatnonzero(found >= SIMILAR).tolist():
                        row = int(owner[part[w]])
                        best[row] = max(best.get(row, 0.0), float(found[w]))
            short = (sizes < n) & (sizes >= SIMILAR * n) & ((sums[ends] - sums[starts]) * (1 + SIMILAR) >= SIMILAR * (n + sizes) - 1e-9)
            for row in np.flatnonzero(short).tolist():
                found = similarities(places[ids[starts[row] : ends[row]]][None], counts)[0]
                if found >= SIMILAR:
                    best[row] = float(found)
            for row, similarity in best.items():
                yield row, item, similarity


def _rows(items: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Item and words of the items that have any; hashed on the executors, they come to the driver a part at a time."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, sizes = word_hashes(batch.column("text").to_pylist())
        keep = np.flatnonzero(sizes)
        return pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(keep)), ragged(hashes.view(np.int64), sizes[keep], pa.int64())], ["item_id", "words"])

    known = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    for row in map_text(known, run, "item_id bigint, words array<bigint>").toLocalIterator():
        yield row.item_id, np.array(row.words, np.int64).view(np.uint64)


def _whole_items(items: DataFrame) -> Iterator[Items]:
    """The whole items for each pass, in blocks of about WINDOWS words."""
    current: list[tuple[int, np.ndarray]] = []
    held = 0
    for item, words in _rows(items):
        current.append((item, words))
        held += len(words)
        if held >= WINDOWS:
            yield Items(current)
            current, held = [], 0
    if current:
        yield Items(current)


def _item_blocks(items: DataFrame) -> Iterator[dict[int, Passages]]:
    """The index for each pass; the items come to the driver one block at a time, passages cut on the way."""
    current: dict[int, list[tuple[np.ndarray, int]]] = {}
    held = 0

    def closed() -> dict[int, Passages]:
        return {n: Passages(n, np.concatenate([w for w, _ in rows]), np.repeat([i for _, i in rows], [len(w) for w, _ in rows])) for n, rows in current.items()}

    for item, words in _rows(items):
        n = min(PASSAGE, len(words))
        current.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(words, n), item))
        held += len(words) - n + 1
        if held >= WINDOWS:
            yield closed()
            current, held = {}, 0
    if current:
        yield closed()


def _search(documents: DataFrame, items: DataFrame, near: bool) -> DataFrame:
    """doc_id, item_id, similarity of documents that hold a passage, if near also of those with a window like an item."""
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, similarity double"
    whole = spark.createDataFrame([], schema)
    source = spread(documents.where("text is not null"))
    for block in zip_longest(_item_blocks(items), _whole_items(items) if near else ()):
        shared = spark.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            passages, whole_items = shared.value
            hashes, sizes = word_hashes(batch.column("text").to_pylist())
            if not len(hashes):
                return None
            owner = np.repeat(np.arange(len(sizes)), sizes)
            best: dict[tuple[int, int], float] = {}
            for n, window, passage in _candidates(hashes, passages) if passages else ():
                known = passages[n]
                inside = owner[window] == owner[window + n - 1]
                window, passage = window[inside], passage[inside]
                same = np.ones(len(window), bool)
                for j in range(n):
                    same &= hashes[window + j] == known.words[passage, j]
                for row, item in set(zip(owner[window[same]].tolist(), known.items[passage[same]].tolist(), strict=True)):
                    best[row, item] = 1.0
            for row, item, similarity in whole_items.near(hashes, sizes) if whole_items else ():
                best[row, item] = max(best.get((row, item), 0.0), similarity)
            if not best:
                return None
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([row for row, _ in best], pa.int64())), pa.array([item for _, item in best], pa.int64()), pa.array(list(best.values()), pa.float64())],
                ["doc_id", "item_id", "similarity"],
            )

        whole = whole.unionByName(map_text(source, run, schema, most=1 << 20))
    return whole.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text")


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found: doc_id, item_id of documents that hold a passage of the item word for word."""
    return _search(*_read(spark, sf_dir), near=False).select("doc_id", "item_id")


def nearly_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_near: doc_id, item_id, similarity: the documents of p9_found with 1, those with an edited copy of the
    whole item with the similarity of the most similar window."""
    return _search(*_read(spark, sf_dir), near=True)


def leaks_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_items: item_id, split, n_documents: how many documents each item leaked into, none for 0."""
    items = table(spark, sf_dir, "eval_items", "item_id", "split").distinct()
    counts = leaked(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(counts, "item_id", "left").select("item_id", "split", F.coalesce("n", F.lit(0)).alias("n_documents"))
