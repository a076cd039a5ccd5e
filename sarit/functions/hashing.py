"""Hashes of words and of runs of words, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash


def stirred(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all bits: two rounds of a rotation folded in and an odd factor."""
    x = x.astype(np.uint64, copy=True)
    for turn, factor in ((23, 0x2127599BF4325C37), (47, 0x880355F21E6D1965)):
        x ^= (x >> np.uint64(turn)) | (x << np.uint64(64 - turn))
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, lower-cased if asked, and the number of words of each; a word is
    hashed once."""
    words = [(t.lower() if lower else t).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    return known[np.asarray(flat.indices)] if len(known) else known, sizes


def shingles(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's runs of `length` words, ascending, all texts' together, and how many are of
    each text. A shorter text is one run, a text without words has none."""
    words, sizes = word_hashes(texts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.flatnonzero((place + length <= sizes[row]) | (place == 0))
    value = np.zeros(len(first), np.uint64)
    for j in range(length):
        inside = place[first] + j < sizes[row[first]]
        at = first[inside] + j
        value[inside] = stirred(value[inside] + words[at])
    row = row[first]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(row[new], minlength=len(sizes))


def found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key among the known ones, which are sorted, and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return place, known[place] == keys
