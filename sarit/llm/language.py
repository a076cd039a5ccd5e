"""Problem 2: missing or wrong document language labels.

Method: rank-order profiles. A language's profile ranks the most frequent character n-grams (one to GRAMS characters,
words padded with a blank) of its trusted samples. A segment (a sentence or a line) is given the language with the
least out-of-place distance: the sum, over the segment's n-grams ranked by frequency, of how far each is from its
place in the profile, an n-gram that the profile lacks being as far as the profile is long. The confidence is the
relative lead over the second. Segments too far from all, or not made of words (code, broken or random characters,
pseudo-Latin), are in no language. Segments with
a small lead (list entries, table rows, short lines) are classified together, by the sum of their distances, and take
the language of the segments around them unless another is clearly less far.

Null, empty and letterless texts have no segments and no rows. Profiles are fitted on the table lang_samples, at most
SAMPLES rows of each language (a documented bound); everything else covers all documents and whole texts.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.llm.labels import label_column
from sarit.llm.lookalike import plain_forms
from sarit.plans.arrow import map_text
from sarit.plans.scale import spread, table

LANGUAGES = ("hi", "ne", "mr", "en")
GRAMS = 3
#: Length of a profile, and most samples of a language that it is fitted on.
PROFILE, SAMPLES = 2000, 10_000
#: How often each frequent function word of a language is put beside its samples.
WORDS = 3
#: Mean distance, as a share of the profile's length, beyond which a segment is in no language: each of LANGUAGES.
FAR = (0.62, 0.62, 0.62, 0.37)
#: Lead under which a segment isn't classified by itself, and that for a segment of fewer than SHORT letters.
LEAD, LEAD_SHORT, SHORT = 0.08, 0.2, 40
#: Segments of fewer letters are never classified by themselves.
SINGLE = 15
#: By how much the pooled distance of a text's unsure segments must be less than that of the language around them.
POOLED = 0.08
#: Weighted letters of unsure segments that can outweigh the language around them.
EVIDENCE = 60
#: Share of digits from which a short segment is a row of a table, made of names mostly, and its weight in that distance.
DIGITS, ROWS_SAY = 0.12, 0.02
#: Least share of a text's letters.
SHARE = 0.2
#: Characters of the segments that are ranked at once.
BLOCK = 2_000_000
_CODE = re.compile(r"[{}<>=;\\\\]|\w_|_\w|\w\(\w*\)|[a-z]\d|\d[a-z]")
_SEGMENT = re.compile(r"[^।॥?!|\n]+?(?:\.(?=\s)|[।॥?!|\n]+|$)")
_BASE = 160


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Code point to number (0: no letter or mark, 1 to 128 Devanagari, then a to z, then any other), and whether it is a letter."""
    import unicodedata

    number, letter = np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        letter[code] = kind[0] == "L"
        if kind[0] not in "LM":
            continue
        if 0x900 <= code < 0x980:
            number[code] = code - 0x900 + 1
        elif 97 <= code < 123:
            number[code] = code - 97 + 129
        elif not 0x300 <= code < 0x370:
            number[code] = 155
    return number, letter


def _grams(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all n-grams, the segment of each, and the number of letters of each segment. An n-gram lies in a word
    with a blank on either side."""
    number, letter = _alphabet()
    codes = np.frombuffer("\n".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    segment = np.cumsum(codes == 10)
    letters = np.bincount(segment[letter[codes]], minlength=len(segments))
    drop = (codes >= 0x300) & (codes < 0x370)
    ids, segment = number[codes[~drop]], segment[~drop]
    ids = np.concatenate([[0], ids, [0]])
    segment = np.concatenate([[0], segment, [len(segments) - 1]])
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    ids, segment = ids[keep], segment[keep]
    single = np.flatnonzero(ids)
    if not len(single):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    before, here, after = ids[single - 1], ids[single], ids[single + 1]
    of = segment[single]
    first = before == 0
    out = [here, _BASE + here * _BASE + after, _BASE + before[first] * _BASE + here[first], _BASE + _BASE**2 + (before * _BASE + here) * _BASE + after]
    return np.concatenate(out).astype(np.int64), np.concatenate([of, of, of[first], of]), letters


class Profiles:
    """The languages' rank-order profiles."""

    def __init__(self, samples: dict[str, list[str]]):
        ranks = {}
        for n, language in enumerate(LANGUAGES):
            codes, _, _ = _grams([t.lower().replace("\n", " ") for t in plain_forms(samples.get(language, []))] or [""])
            known, counts = np.unique(codes, return_counts=True)
            best = np.lexsort((known, -counts))[:PROFILE]
            for rank, code in enumerate(known[best].tolist()):
                ranks.setdefault(code, [PROFILE] * len(LANGUAGES))[n] = rank
        self.codes = np.array(sorted(ranks), np.int64)
        self.ranks = np.array([ranks[c] for c in self.codes.tolist()], np.int32).reshape(-1, len(LANGUAGES))

    def index(self) -> np.ndarray:
        """n-gram code to row of ranks, -1 where no profile has it; built once for each worker."""
        if not hasattr(self, "_index"):
            self._index = np.full(_BASE + _BASE**2 + _BASE**3, -1, np.int32)
            self._index[self.codes] = np.arange(len(self.codes))
        return self._index

    def __getstate__(self) -> dict:
        return {"codes": self.codes, "ranks": self.ranks}

    def distances(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean out-of-place distance of each segment to each language, as a share of PROFILE; letters of each segment.
        Done in blocks of segments of about BLOCK characters, so a very long text needs no more memory than a short one."""
        ends = np.cumsum([len(s) for s in segments])
        parts, start = [], 0
        while start < len(segments):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
            parts.append(self._distances(segments[start:stop]))
            start = stop
        if not parts:
            return np.zeros((0, len(LANGUAGES))), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _distances(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, segment, letters = _grams(segments)
        row = self.index()[codes]
        hit = row >= 0
        absent = np.bincount(segment[~hit], minlength=len(segments))
        width = np.int64(max(1, len(self.codes)))
        keys, counts = np.unique(segment[hit] * width + row[hit], return_counts=True)
        of, row = keys // width, keys % width
        order = np.lexsort((-counts, of))
        of, row, counts = of[order], row[order], counts[order]
        start = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (counts[1:] != counts[:-1])
        place = place[np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))] if len(of) else place  # ties share the best place
        total = np.bincount(of, minlength=len(segments)) + absent
        sums = np.stack([np.bincount(of, np.where(self.ranks[row, n] == PROFILE, PROFILE, np.abs(self.ranks[row, n] - place)), minlength=len(segments)) for n in range(len(LANGUAGES))], 1)
        return (sums + absent[:, None] * PROFILE) / (np.maximum(total, 1)[:, None] * PROFILE), letters


def worded(segment: str, letters: int, latin: bool) -> bool:
    """Whether a segment is made of words, not of code, single letters or random characters."""
    words = segment.split()
    if len(words) >= 6 and sum(map(len, words)) < 2 * len(words):
        return False
    if latin:
        return 2 * letters >= sum(map(len, words)) and len(_CODE.findall(segment.lower())) <= 0.12 * len(words)
    return letters < 8 or sum(map(len, words)) - letters >= 0.2 * letters  # marks, digits and punctuation


def classify(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all segments: text, row, language number (-1: none), confidence, letters."""
    rows = [i for i, t in enumerate(texts) if t]
    segments: list[str] = []
    row: list[int] = []
    for i, text in zip(rows, plain_forms([texts[i] for i in rows]), strict=True):
        found = [s for s in _SEGMENT.findall(text) if s.strip()]
        segments += found
        row += [i] * len(found)
    if not segments:
        empty = np.zeros(0, np.int64)
        return [], empty, empty, empty.astype(float), empty
    far, letters = profiles.distances([s.lower().replace("\n", " ") for s in segments])
    row = np.array(row)
    order = np.argsort(far, axis=1, kind="stable")
    each = np.arange(len(far))
    best, second = far[each, order[:, 0]], far[each, order[:, 1]]
    lead = np.where(second > 0, (second - best) / np.maximum(second, 1e-9), 0.0)
    language = np.where((best <= np.array(FAR)[order[:, 0]]) & (letters > 0), order[:, 0], -1)
    for i in np.flatnonzero(language >= 0).tolist():
        if not worded(segments[i], int(letters[i]), language[i] == LANGUAGES.index("en")):
            language[i] = -1
    own = (language >= 0) & (language != LANGUAGES.index("en"))
    cells = np.zeros(len(segments), bool)
    for i in np.flatnonzero(own & (letters < SHORT)).tolist():
        cells[i] = sum(map(str.isdecimal, segments[i])) >= DIGITS * len(segments[i])
    unsure = own & (cells | (letters < SINGLE) | (lead < np.where(letters < SHORT, LEAD_SHORT, LEAD)))
    if unsure.any():
        sure = ~unsure & (language >= 0)
        weight, pooled = np.zeros((len(texts), len(LANGUAGES))), np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(weight, (row[sure], language[sure]), letters[sure])
        at = np.flatnonzero(unsure)
        np.add.at(pooled, row[at], far[at] * (letters[at] * np.where(cells[at], ROWS_SAY, 1.0))[:, None])
        weight[:, LANGUAGES.index("en")] = 0
        pooled[:, LANGUAGES.index("en")] = np.inf
        together, around = pooled.argmin(1), weight.argmax(1)
        at = np.arange(len(texts))
        known = weight.max(1) > 0
        enough = np.bincount(row[unsure], letters[unsure] * np.where(cells[unsure], ROWS_SAY, 1.0), minlength=len(texts)) >= EVIDENCE
        better = enough & (pooled[at, around] > pooled[at, together] * (1 + POOLED))
        choice = np.where(known & ~better, around, together)
        language = np.where(unsure, choice[row], language)
    return segments, row, language, lead, letters


def profiles_of(spark: SparkSession, sf_dir: str) -> Profiles:
    """Fitted on at most SAMPLES samples of each language, those of least sample_id, and as many of its common words."""
    common = table(spark, sf_dir, "common_words", "word", label_column("lang").alias("lang")).where("lang is not null and word is not null")
    samples = table(spark, sf_dir, "lang_samples", "sample_id", "text", label_column("lang").alias("lang")).where("lang is not null and text is not null")
    out = {}
    for language in LANGUAGES:
        out[language] = [r.text for r in samples.where(F.col("lang") == language).orderBy("sample_id", "text").limit(SAMPLES).collect()]
        out[language] += WORDS * [" ".join(r.word for r in common.where(F.col("lang") == language).orderBy("word").limit(SAMPLES).collect())]
    return Profiles(out)


def shares(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang, language, share, confidence: for each language with letters in a text its share of all letters.

    The confidence is the letters' mean of their segments' confidence. Of the columns only doc_id, text and lang matter."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        _, row, language, lead, letters = classify(batch.column("text").to_pylist(), shared.value)
        n = batch.num_rows
        total = np.bincount(row, letters, minlength=n) if len(row) else np.zeros(n)
        weight, sure = np.zeros((n, len(LANGUAGES))), np.zeros((n, len(LANGUAGES)))
        known = language >= 0
        np.add.at(weight, (row[known], language[known]), letters[known])
        np.add.at(sure, (row[known], language[known]), letters[known] * lead[known])
        at, of = np.nonzero(weight)
        take = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("lang").take(take), pa.array([LANGUAGES[i] for i in of.tolist()], pa.string()), pa.array(weight[at, of] / total[at]), pa.array(sure[at, of] / weight[at, of])],
            ["doc_id", "lang", "language", "share", "confidence"],
        )

    return map_text(documents.select("doc_id", "lang", "text"), run, "doc_id bigint, lang string, language string, share double, confidence double")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: doc_id, lang of each language with a fifth of the letters that the label doesn't name."""
    out = shares(_documents(spark, sf_dir), profiles_of(spark, sf_dir))
    wrong = (F.col("share") >= SHARE) & (label_column("lang").isNull() | (label_column("lang") != F.col("language")))
    return out.where(wrong).select("doc_id", F.col("language").alias("lang")).distinct()


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_documents: doc_id, language, confidence, share: the language of most letters; no row for a text in none."""
    out = shares(_documents(spark, sf_dir), profiles_of(spark, sf_dir))
    best = F.max_by(F.struct("language", "confidence", "share"), F.struct("share", "language")).alias("best")
    return out.groupBy("doc_id").agg(best).select("doc_id", "best.*")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_passages: doc_id, passage (from 0), language, confidence, letters: neighbouring segments of one language as one."""
    shared = spark.sparkContext.broadcast(profiles_of(spark, sf_dir))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        _, row, language, lead, letters = classify(batch.column("text").to_pylist(), shared.value)
        if not len(row):
            return None
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (language[1:] != language[:-1])
        start = np.flatnonzero(new)
        size = np.add.reduceat(letters, start)
        sure = np.add.reduceat(letters * lead, start) / np.maximum(size, 1)
        of = row[start]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        number = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        names = pa.array([LANGUAGES[i] if i >= 0 else None for i in language[start].tolist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array(number, pa.int32()), names, pa.array(sure), pa.array(size, pa.int64())], ["doc_id", "passage", "language", "confidence", "letters"])

    return map_text(_documents(spark, sf_dir), run, "doc_id bigint, passage int, language string, confidence double, letters bigint")
