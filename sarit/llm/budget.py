"""Problem 4: token budget per source and language.

Method: the vocabulary's pieces stand in a double-array trie over UTF-8 bytes. Texts are normalized as the tokenizer
does (blanks as its word mark, one before the text) and cut into segments, a word with the marks before it; the best
path of each distinct segment is found by a Viterbi that only keeps counts, for all segments of a chunk at once, and
the paths' lengths are summed by text and by slice. A character without a piece costs a token for each byte.

The vocabulary is a parameter. The public files hold no unigram vocabulary, only BPE ones, and none is trained here:
for a piece of rank r the score is its share by Zipf's law, -log(r + 2.7), a constant per token less. For this
vocabulary a test holds the estimate against the tokenizer itself.

Null and empty texts have no tokens. Null sources, labels that name no language and sources without a registry
category are slices of their own, as null. Texts are counted whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.llm.labels import label_column
from sarit.llm.repeated_lines import with_site
from sarit.plans.arrow import map_text
from sarit.plans.scale import broadcast_if_small, spread, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Added to each token's score: fewer tokens are better. A byte's score.
EACH, BYTE = -3.0, -14.0
#: Most segments whose counts a worker remembers; memory only.
REMEMBERED = 400_000
#: Longer segments, in bytes, are counted in a Viterbi of their own row.
WIDTHS = (8, 16, 32, 64, 128, 256)


class Trie:
    """A double array: from state s by byte b to base[s] + b + 1 if check of that is s; score is nan where no piece ends."""

    def __init__(self, pieces: dict[bytes, float]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, float] = {}
        for piece, score in pieces.items():
            node = 0
            for byte in piece:
                node = children[node].setdefault(byte, len(children)) if byte in children[node] else self._grow(children, node, byte)
            ends[node] = score
        size = 8 * len(children) + 65_536
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        score = np.full(size, np.nan)
        taken = bytearray(size)
        taken[0] = 1
        place = {0: 0}
        free = 1
        tried: dict[int, int] = {}
        queue = [0]
        for node in queue:
            at = place[node]
            if node in ends:
                score[at] = ends[node]
            if not children[node]:
                continue
            keys = sorted(children[node])
            while taken[free]:
                free += 1
            start = max(0, free - keys[0] - 1, tried.get(len(keys), 0))
            while any(taken[start + k + 1] for k in keys):
                start += 1
            tried[len(keys)] = start  # lower places were taken for as many children; few fit later
            base[at] = start
            for key in keys:
                to = start + key + 1
                taken[to] = 1
                check[to] = at
                place[children[node][key]] = to
                queue.append(children[node][key])
        top = len(taken) - 1
        while not taken[top]:
            top -= 1
        self.base, self.check, self.score = base[: top + 258], check[: top + 258], score[: top + 258]
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def _grow(children: list[dict[int, int]], node: int, byte: int) -> int:
        children[node][byte] = len(children)
        children.append({})
        return children[node][byte]

    def counts(self, segments: list[bytes]) -> np.ndarray:
        """Tokens on the best path of each segment."""
        out = np.zeros(len(segments), np.int64)
        sizes = np.array([len(s) for s in segments])
        low = 0
        widths = [*WIDTHS, *([int(sizes.max())] if len(sizes) and sizes.max() > WIDTHS[-1] else [])]
        for width in widths:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for part in np.array_split(rows, max(1, len(rows) * width // 600_000)):
                if len(part):
                    out[part] = self._paths([segments[i] for i in part], sizes[part], width)
            low = width
        return out

    def _paths(self, segments: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        n = len(segments)
        text = np.zeros((n, width), np.int32)
        text[np.arange(width)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(segments), np.uint8)
        best = np.full((width + 1, n), -np.inf)
        count = np.zeros((width + 1, n), np.int32)
        best[0] = 0
        first = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        for i in range(width):
            rows = np.flatnonzero((best[i] > -np.inf) & (sizes > i))
            if not len(rows):
                continue
            size = np.minimum(first[rows, i], sizes[rows] - i)
            for length in np.unique(size).tolist():  # the character as bytes
                self._relax(best, count, i, i + length, rows[size == length], length * (BYTE + EACH), length)
            state = np.zeros(len(rows), np.int32)
            for j in range(i, min(width, i + self.longest)):
                inside = sizes[rows] > j
                rows, state = rows[inside], state[inside]
                to = self.base[state] + text[rows, j] + 1
                good = self.check[to] == state
                rows, state = rows[good], to[good]
                if not len(rows):
                    break
                score = self.score[state]
                end = ~np.isnan(score)
                if end.any():
                    self._relax(best, count, i, j + 1, rows[end], score[end] + EACH, 1)
        return count[sizes, np.arange(n)]

    @staticmethod
    def _relax(best: np.ndarray, count: np.ndarray, i: int, j: int, rows: np.ndarray, score: np.ndarray | float, tokens: int) -> None:
        value = best[i, rows] + score
        better = value > best[j, rows]
        rows = rows[better]
        best[j, rows] = value[better]
        count[j, rows] = count[i, rows] + tokens


@cache
def trie(path: str) -> Trie:
    """The trie of a sentencepiece file, one for each Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Trie({model.id_to_piece(i).encode(): -float(np.log(rank + 2.7)) for rank, i in enumerate(normal)})


class Counter:
    """Tokens of texts, remembering the counts of segments between chunks."""

    def __init__(self, path: str):
        import re

        self.trie = trie(path)
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        parts = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({p for ps in parts for p in ps if p not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({p for ps in parts for p in ps})
        self.known.update(zip(new, self.trie.counts([p.encode() for p in new]).tolist(), strict=True))
        return np.array([sum(map(self.known.__getitem__, ps)) for ps in parts], np.int64)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def counted(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, n_tokens of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = counter(vocabulary)(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(tokens)], ["doc_id", "source", "lang", "n_tokens"])

    return map_text(documents.select("doc_id", "source", "lang", "text"), run, "doc_id bigint, source string, lang string, n_tokens bigint")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"))


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_tokens: doc_id, n_tokens."""
    return counted(_documents(spark, sf_dir)).select("doc_id", "n_tokens")


def by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_budget: source (a host as its site), lang (hi, ne, mr, en or null), category, n_documents, n_tokens."""
    registry = table(spark, sf_dir, "registry", "site", "host", "category")
    categories = registry.where("site is not null").groupBy("site").agg(F.min("category").alias("category"))
    tokens = counted(_documents(spark, sf_dir)).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"))
    known = with_site(tokens, registry).join(broadcast_if_small(categories), "site", "left")
    return known.groupBy(F.col("site").alias("source"), label_column("lang").alias("lang"), "category").agg(F.sum("n").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


def errors(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """p4_error: lang, n_documents, n_tokens (estimated), n_exact (the tokenizer's own number), error: the relative error of
    the sum, and share_exact of documents with the exact number, by the language of the label, over all documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import sentencepiece

        model = models.setdefault(vocabulary, None) or sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        models[vocabulary] = model
        texts = batch.column("text").to_pylist()
        exact = [len(ids) for ids in model.encode([t or "" for t in texts], num_threads=1)]
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(counter(vocabulary)(texts)), pa.array(exact, pa.int64())], ["lang", "n_tokens", "n_exact"])

    models: dict = {}  # of each Python worker
    counts = map_text(_documents(spark, sf_dir).select("lang", "text"), run, "lang string, n_tokens bigint, n_exact bigint")
    sums = counts.groupBy(label_column("lang").alias("lang")).agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_exact").alias("n_exact"), F.avg((F.col("n_tokens") == F.col("n_exact")).cast("int")).alias("share_exact"))
    return sums.withColumn("error", F.when(F.col("n_exact") > 0, F.col("n_tokens") / F.col("n_exact") - 1))
