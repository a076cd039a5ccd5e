"""Problem 8: encoding the whole corpus with a public byte-level BPE.

Method: the distinct pre-tokens of a chunk of texts stand as byte ids in numpy matrices, one for each length class,
padded; each round every row merges its leftmost pair of least rank, found by a hashed pair lookup, and rows are
compacted; rows without a pair leave. A text's ids are then gathered from those of its pre-tokens.

Null and empty texts have the empty list. Every row gives one row, repeated rows too. Special tokens' strings are
ordinary text. The vocabulary file is a parameter: rank files of the tiktoken form (base64 token and rank a line).
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sarit.llm.batches import mix64, spans
from sarit.plans.arrow import map_text, ragged
from sarit.plans.scale import spread, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern of the public vocabulary, and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Most distinct words whose ids a worker remembers between chunks; memory only, no result depends on it.
REMEMBERED = 200_000
#: Longer pre-tokens, in bytes, are merged with a heap, which stays near linear in their length.
LONGEST_ROW = 256


class Merges:
    """Pair of token ids to merged id and rank, as an open-addressing table in numpy."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = np.int64(max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        size = 1 << (2 * len(pairs) - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros(size, np.int64)
        slot = (mix64(keys) & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):  # each round fills the free slots, one key each, and moves the rest on
            self.probes += 1
            free = self.keys[slot[left]] == -1
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]] = keys[put]
            self.values[slot[put]] = values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & int(self.mask)
        self.none = np.int64(self.width)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank, which is the id of the merged token; `none` where the pair doesn't merge or a side is padding (-1)."""
        key = left * self.width + right
        slot = (mix64(key) & self.mask).astype(np.int64)
        out = np.full(key.shape, self.none)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        flat_key, flat_slot = key.ravel(), slot.ravel()
        result = out.ravel()
        while len(open_):
            there = self.keys[flat_slot[open_]]
            hit = there == flat_key[open_]
            result[open_[hit]] = self.values[flat_slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
            flat_slot[open_] = (flat_slot[open_] + 1) & int(self.mask)
        return result.reshape(key.shape)

    def matrix(self, tokens: np.ndarray) -> np.ndarray:
        """Rows of byte ids, padded with -1 on the right, merged until no row has a pair."""
        tokens = tokens.copy()
        alive = np.arange(len(tokens))
        work = tokens
        while work.shape[1] > 1 and len(alive):
            ranks = self.rank(work[:, :-1].ravel(), work[:, 1:].ravel()).reshape(len(work), -1)
            at = ranks.argmin(1)  # the leftmost of the least
            least = ranks[np.arange(len(work)), at]
            merges = least < self.none
            tokens[alive[~merges], : work.shape[1]] = work[~merges]
            tokens[alive[~merges], work.shape[1] :] = -1
            alive, work, at, least = alive[merges], work[merges], at[merges], least[merges]
            if not len(alive):
                return tokens
            work[np.arange(len(work)), at] = least
            column = np.arange(work.shape[1] - 1)
            work = np.where(column[None, :] > at[:, None], work[:, 1:], work[:, :-1])
            most = int((work >= 0).sum(1).max())
            work = work[:, :most]
        tokens[alive, : work.shape[1]] = work
        tokens[alive, work.shape[1] :] = -1
        return tokens

    def long(self, text: bytes) -> list[int]:
        """One long row: a heap of pairs over a linked list, leftmost least rank first."""
        ids = [int(i) for i in self.byte[np.frombuffer(text, np.uint8)]]
        width, pairs = int(self.width), self.pairs
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else len(ids)
            if j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (r := pairs.get(rank * width + ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (k := before[i]) >= 0 and (r := pairs.get(ids[k] * width + rank)) is not None:
                heapq.heappush(heap, (r, k, ids[k], rank))
        return [i for i in ids if i >= 0]

    def encode(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token; length classes are powers of two."""
        out: list = [None] * len(tokens)
        sizes = np.array([len(t) for t in tokens])
        for i in np.flatnonzero(sizes > LONGEST_ROW):
            out[i] = np.array(self.long(tokens[i]), np.int32)
        low = 0
        width = 2
        while low < LONGEST_ROW:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for part in np.array_split(rows, max(1, len(rows) * width // 400_000)):
                if not len(part):
                    continue
                joined = self.byte[np.frombuffer(b"".join(tokens[i] for i in part), np.uint8)]
                matrix = np.full((len(part), width), -1, np.int64)
                matrix[np.arange(width)[None, :] < sizes[part][:, None]] = joined
                for i, row in zip(part, self.matrix(matrix), strict=True):
                    out[i] = row[row >= 0].astype(np.int32)
            low, width = width, width * 2
        return out


class Encoder:
    """Texts to ids, remembering the ids of words between chunks."""

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        self.split = regex.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.pre_tokens = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.tokens: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.used = 0

    def learn(self, words: list[str]) -> None:
        if len(self.numbers) + len(words) > REMEMBERED:
            self.forget()
            raise KeyError
        parts = [self.pre_tokens(w) for w in words]
        unknown = list({p for ps in parts for p in ps if p not in self.tokens})
        if len(self.tokens) + len(unknown) > REMEMBERED:
            self.tokens.clear()
            unknown = list({p for ps in parts for p in ps})
        self.tokens.update(zip(unknown, self.merges.encode([p.encode() for p in unknown]), strict=True))
        for word, ps in zip(words, parts, strict=True):
            ids = np.concatenate([self.tokens[p] for p in ps])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.numbers[word] = len(self.starts)
            self.starts.append(self.used)
            self.sizes.append(len(ids))
            self.used += len(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many belong to each text."""
        words = [self.split(t) for t in texts]
        flat = [w for ws in words for w in ws]
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        new = list({w for w in flat if w not in self.numbers})
        if new:
            try:
                self.learn(new)
            except KeyError:
                new = list(dict.fromkeys(flat))
                if len(new) > REMEMBERED:
                    half = len(texts) // 2
                    if half:
                        one, two = self(texts[:half]), self(texts[half:])
                        return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
                    return self.single(flat)
                self.learn(new)
        numbers = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        sizes = np.array(self.sizes, np.int64)[numbers]
        ids = self.flat[spans(np.array(self.starts, np.int64)[numbers], sizes)]
        ends = np.cumsum(sizes)
        counts = np.cumsum([len(ws) for ws in words])
        ends = np.append(0, ends)[counts]
        return ids, np.diff(ends, prepend=0)

    def single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One text of more distinct words than are remembered, in blocks."""
        done = []
        for i in range(0, len(words), REMEMBERED // 2):
            block = words[i : i + REMEMBERED // 2]
            self.forget()
            self.learn(list(dict.fromkeys(block)))
            done += [self.flat[self.starts[n] : self.starts[n] + self.sizes[n]].copy() for n in map(self.numbers.__getitem__, block)]
        ids = np.concatenate(done)
        return ids, np.array([len(ids)])


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def encode_column(df: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids of every row of a table with key and text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes = encoder(vocabulary)(batch.column("text").fill_null("").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(key), ragged(ids, sizes, pa.int32())], [key, "ids"])

    return map_text(spread(df.select(key, "text")), run, f"{key} bigint, ids array<int>", most=1 << 20)


def corpus_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_ids: doc_id and the token ids of each document."""
    return encode_column(table(spark, sf_dir, "documents", "doc_id", "text"))
