"""Problem 1: per-document text quality statistics.

Method: statistics of each document (STATISTICS) are computed in one pass; mergeable quantile sketches (KLL) of each
are built per language, partition by partition, and merged; values become robust z-scores by the sketches' median and
spread, within the language and within the whole corpus. Documents in the distributions' tails (FLAGGED: far fewer common
words, far more symbols, digits or single letters, far longer words than text has) are flagged, and only these can be
cases. An exact check follows, since a case is defined by a fixed share: more than half of the characters (OUTSIDE) must
stand outside running sentences or verse. What counts as a tail follows from the corpus, in no fixed unit.

Recurrent lines (problem 5) are taken out before any statistic, and the cases of problem 10 are none here. Null,
empty and blank texts, and texts of recurrent lines only, have null statistics and are no cases. Statistics are of
whole texts. The language of the sketches is the normal form of the label, "other" where it names none.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.llm.labels import label_column
from sarit.llm.repeated_lines import Lines
from sarit.llm.residue import TITLE, evidence, residuals
from sarit.plans.arrow import map_text
from sarit.plans.scale import broadcast_if_small, cut, table

SKETCHED = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "terminal_line_share", "common_word_share", "distinct_word_share", "single_letter_share", "mark_ratio")
#: The last is of the exact check; it isn't sketched and flags nothing.
STATISTICS = (*SKETCHED, "outside_share")
#: Size parameter of the sketches; the rank error is about 2.3 / K.
K = 400
#: Robust z-score beyond which a value is in the tail, and the least spread as a share of the statistic's range.
TAIL, LEAST_SPREAD = 3.0, 0.02
#: The tails that flag a document: statistic to side and z-score.
FLAGGED = {"common_word_share": (-1, 3.0), "symbol_ratio": (1, 6.0), "digit_ratio": (1, 6.0), "single_letter_share": (1, 6.0), "mean_word_length": (1, 6.0)}
#: Share of characters outside running text that makes a case.
OUTSIDE = 0.5
#: Fewer visible characters than these outside running text (a headline, a name) make no case.
SHORT = 60

# Frequent function words beside those of the table common_words.
FUNCTION_WORDS = frozenset(
    "सँग तिर अब अझ बाट देखि सम्म हुन्छ भएको भएका गरेको गर्छ मेरो मेरी हाम्रो तिमी म हामी नै वा अनि कहाँ कसरी छैन छिन् थिए हुन् चाहिँ कुन हो यी ती यति त "
    "मत न ही अब मेरा मेरी मेरे हम तुम मैं वह वे ये ओर कौन कैसे कहाँ हुआ हुई हुए रहा रही रहे करना किया थीं वाला वाले वाली ने सा सी जो कोई कुछ "
    "मी तू मला माझे माझा माझी आमचे नाही ना ही हा ते ती त्या त्याने काय कोण कसे आता मग नको झाली झाले झाला होती होता यांची यांना येथील नुसार "
    "i you he she we they my your our not no be are or but so if it's this these those which who what when where how do does did has had can could would still there here".split()
)
# Endings of inflected words.
ENDINGS = ("को", "ले", "लाई", "बारे", "देखि", "सम्म", "भन्दा", "मा", "बाट", "सँग", "पछि", "अघि")
_TERMINAL = re.compile(r"[।॥?!.…|][\"'”’)\]]*\s*$")
_SPLIT = re.compile(r"(?<=[।॥?!…|])\s*|(?<=\.)\s+")
_CODE = re.compile(r"[{}<>=;\\]|\w\(\w*\)|\w_\w|_\w|\w_")
_BULLET = re.compile(r"^\s*(?:[-*•◦▪›→»>+–—]|\(?[\d०-९a-zA-Z]{1,3}[.)\]])\s*")
_SEPARATORS = frozenset("/ · | - • > »".split())
_STRIP = "\"'“”‘’()[]{}<>«»,;:.!?।॥|…-–—/*#"


@cache
def _kinds() -> np.ndarray:
    """Code point to kind: 0 space, 1 ASCII letter, 2 Devanagari letter, 3 Devanagari mark, 4 digit, 5 common
    punctuation, 6 other letter or mark, 7 other."""
    import unicodedata

    kinds = np.full(0x110000, 7, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        if category in ("Zs", "Zl", "Zp") or code in (9, 10, 11, 12, 13):
            kinds[code] = 0
        elif category[0] in "LM":
            kinds[code] = (3 if category[0] == "M" else 2) if 0x900 <= code < 0x980 else 1 if code < 128 else 6
        elif category == "Nd":
            kinds[code] = 4
    for ch in ".,!?;:'\"()-–—।॥|“”‘’…":
        kinds[ord(ch)] = 5
    # decomposed accents belong to Latin words
    kinds[0x300:0x370] = 1
    return kinds


class Words:
    """Features of words, remembered between chunks (memory only): kinds of characters and whether a word is common."""

    LENGTH, REAL, BARE, SINGLE, COMMON, SEPARATOR, CODE, LATIN, LETTER, MARK, DIGIT, PUNCTUATION, FOREIGN, OTHER = range(14)

    def __init__(self, common: frozenset[str], most: int = 300_000):
        self.common, self.most = common, most
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.bares: list[int] = []
        self.matrix = np.zeros((0, 14), np.int32)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of features and the number of the bare, lower-case word (0: none) of each word."""
        if len(self.numbers) > self.most:
            self.forget()
        new = list({w for w in words if w not in self.numbers})
        if new:
            sizes = np.array([len(w) for w in new])
            kinds = _kinds()[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
            starts = np.cumsum(sizes) - sizes
            kind = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int32) for k in range(1, 8)], 1)
            rows = []
            for word in new:
                bare = word.strip(_STRIP).lower()
                n = len(bare)
                self.numbers[word] = len(self.numbers)
                self.bares.append(self.bare.setdefault(bare, len(self.bare) + 1) if bare else 0)
                rows.append((len(word), n > 0, n, n == 1, n > 0 and (bare in self.common or n >= 5 and bare.endswith(ENDINGS)), word[-1] in ",;،、" or word in _SEPARATORS, len(_CODE.findall(word))))
            self.matrix = np.concatenate([self.matrix, np.concatenate([np.array(rows, np.int32), kind], 1)])
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return self.matrix[number], np.array(self.bares, np.int64)[number]


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct values over 0 in each group."""
    real = value > 0
    return np.bincount(np.unique(group[real] << np.int64(32) | value[real]) >> np.int64(32), minlength=groups)


def running(sums: np.ndarray, n: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Whether pieces of lines, without bullets, read as sentences or verses, by the sums of their words' features."""
    w = Words
    length, real = sums[:, w.LENGTH], sums[:, w.REAL]
    letters = sums[:, w.LATIN] + sums[:, w.LETTER] + sums[:, w.MARK]
    out = (real >= 3) & (letters >= 0.6 * length) & (sums[:, w.FOREIGN] + sums[:, w.OTHER] <= 0.15 * length) & (sums[:, w.DIGIT] <= 0.3 * length)
    out &= sums[:, w.SINGLE] <= 0.34 * real
    out &= (sums[:, w.LETTER] < 8) | (sums[:, w.MARK] >= 0.2 * sums[:, w.LETTER])
    out &= sums[:, w.CODE] <= 0.12 * n
    out &= (real < 12) | (distinct >= 0.4 * real)
    out &= (n < 8) | (sums[:, w.SEPARATOR] <= 0.34 * n)
    return out & (sums[:, w.COMMON] * 14 >= real)


def measure(residuals: list[list[str] | None], words: Words) -> list[np.ndarray | None]:
    """STATISTICS of each residual, in order; None for none."""
    flat: list[str] = []
    piece_words: list[int] = []
    piece_line: list[int] = []
    line_doc: list[int] = []
    listed: list[bool] = []
    ends: list[bool] = []
    short_first: list[bool] = []
    bullets = np.zeros(len(residuals))
    for doc, lines in enumerate(residuals):
        for i, line in enumerate(lines or ()):
            text = _BULLET.sub("", line)
            bullets[doc] += len(text) != len(line)
            end = _TERMINAL.search(text) is not None
            short_first.append(i == 0 and len(lines) > 1 and len(line) <= TITLE)
            listed.append(len(text) != len(line) and len(text) < 60 and not end)
            ends.append(end)
            for piece in _SPLIT.split(text):
                found = piece.split()
                if found:
                    flat += found
                    piece_words.append(len(found))
                    piece_line.append(len(line_doc))
            line_doc.append(doc)
    out: list[np.ndarray | None] = [None] * len(residuals)
    if not flat:
        return [np.zeros(len(STATISTICS)) if lines else None for lines in residuals]
    features, bare = words.features(flat)
    n = np.array(piece_words)
    starts = np.cumsum(n) - n
    sums = np.add.reduceat(features, starts, axis=0).astype(np.int64)
    piece = np.repeat(np.arange(len(n)), n)
    line_of, doc_of = np.array(piece_line), np.array(line_doc)
    reads = running(sums, n, _distinct(piece, bare, len(n)))
    docs, lines_n = len(residuals), len(line_doc)
    reading_line = np.bincount(line_of, reads, minlength=lines_n) > 0
    reads |= reading_line[line_of] & (n < 4)  # a few words between sentences
    reads &= ~np.array(listed)[line_of]
    title = np.array(short_first) & ~reading_line
    size = np.where(title[line_of], 0, sums[:, Words.LENGTH])
    at = doc_of[line_of]
    total = np.bincount(at, size, minlength=docs)
    outside = total - np.bincount(at, size * reads, minlength=docs)
    whole = np.zeros((docs, sums.shape[1]))
    np.add.at(whole, at, sums)
    count = np.bincount(at, n, minlength=docs)
    distinct = _distinct(at[piece], bare, docs)
    terminal = np.bincount(doc_of, ends, minlength=docs) / np.maximum(1, np.bincount(doc_of, minlength=docs))
    real, visible = np.maximum(1, whole[:, Words.REAL]), np.maximum(1, whole[:, Words.LENGTH] + bullets)
    values = np.stack(
        [
            count,
            whole[:, Words.BARE] / real,
            (whole[:, Words.PUNCTUATION] + whole[:, Words.OTHER] + bullets) / visible,
            whole[:, Words.DIGIT] / visible,
            terminal,
            whole[:, Words.COMMON] / real,
            distinct / real,
            whole[:, Words.SINGLE] / real,
            whole[:, Words.MARK] / np.maximum(1, whole[:, Words.LETTER] + whole[:, Words.MARK]),
            np.where(outside >= SHORT, outside / np.maximum(1, total), 0.0),
        ],
        1,
    )
    for i, lines in enumerate(residuals):
        if lines:
            out[i] = values[i]
    return out


def common_words(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """The words of the table common_words, bounded by a check, and FUNCTION_WORDS, in the form of residuals."""
    from sarit.llm.lookalike import plain_forms

    most = 100_000
    words = [r.word for r in table(spark, sf_dir, "common_words", "word").where("word is not null").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"common_words holds more than {most} words; it is a list of frequent function words")
    return frozenset(w.lower() for w in plain_forms(sorted({*words, *FUNCTION_WORDS})))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, language, residue (whether problem 10 claims it), and STATISTICS of every document, null without a residual."""
    common = common_words(spark, sf_dir)
    state: dict[str, Words] = {}  # of each Python worker
    flagged, shared = Lines(spark, sf_dir, "lang").flagged()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = residuals(batch, shared)
        values = measure(rows, state.setdefault("words", Words(common)))
        columns = [pa.array([None if v is None else v[i] for v in values], pa.float64()) for i in range(len(STATISTICS))]
        residue = pa.array([bool(r) and evidence(r) is not None for r in rows])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), residue, *columns], ["doc_id", "lang", "residue", *STATISTICS])

    schema = "doc_id bigint, lang string, residue boolean, " + ", ".join(f"{s} double" for s in STATISTICS)
    return map_text(flagged, run, schema).withColumn("lang", F.coalesce(label_column("lang"), F.lit("other"))).withColumnRenamed("lang", "language")


def sketched(statistics: DataFrame) -> DataFrame:
    """language, and median and spread (the larger side of the middle half, scaled to a normal deviation) of each
    statistic; the row of the null language is of the whole corpus, from the merged sketches of the languages."""
    sketches = cut(statistics.where("outside_share is not null").groupBy("language").agg(*(F.kll_sketch_agg_double(s, F.lit(K)).alias(s) for s in SKETCHED)))
    whole = sketches.agg(*(F.kll_merge_agg_double(s, F.lit(K)).alias(s) for s in SKETCHED)).where(f"{SKETCHED[0]} is not null").withColumn("language", F.lit(None).cast("string"))
    every = sketches.unionByName(whole)
    parts = F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.0, 1.0)))
    out = every.select("language", *(F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, parts)).alias(s) for s in SKETCHED)).where(f"{SKETCHED[0]} is not null")
    columns = []
    for s in SKETCHED:
        low, middle, high, least, most = (F.col(s)[i] for i in range(5))
        spread = F.greatest(high - middle, middle - low, (most - least) * LEAST_SPREAD, F.lit(1e-9)) / 0.6745
        columns += [middle.alias(f"{s}_median"), spread.alias(f"{s}_spread")]
    return out.select("language", *columns)


def scored(statistics: DataFrame) -> DataFrame:
    """The statistics with robust z-scores: s_z within the language, s_zz within the whole corpus. The sketches' table
    has a row for each language, six at most."""
    table_ = cut(sketched(statistics))
    of_all = table_.where("language is null").drop("language").select(*(F.col(f"{s}_{x}").alias(f"{s}_{x}_all") for s in SKETCHED for x in ("median", "spread")))
    joined = statistics.join(broadcast_if_small(table_.where("language is not null")), "language", "left").join(F.broadcast(of_all), how="left")  # one row
    z = [((F.col(s) - F.col(f"{s}_median")) / F.col(f"{s}_spread")).alias(f"{s}_z") for s in SKETCHED]
    zz = [((F.col(s) - F.col(f"{s}_median_all")) / F.col(f"{s}_spread_all")).alias(f"{s}_zz") for s in SKETCHED]
    return joined.select(*statistics.columns, *z, *zz)


def in_tail(statistic: str) -> Column:
    return F.greatest(F.abs(f"{statistic}_z"), F.abs(f"{statistic}_zz")) > TAIL


def flagged() -> Column:
    """Whether a row of scored() lies in one of the tails FLAGGED, of its language or of the corpus."""
    return reduce(or_, (F.coalesce(F.greatest(F.col(f"{s}_z") * side, F.col(f"{s}_zz") * side) > z, F.lit(False)) for s, (side, z) in FLAGGED.items()))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_statistics: doc_id, language, STATISTICS, the z-scores of those sketched, tails: the statistics in whose tails it
    lies, and flagged."""
    out = scored(cut(measured(spark, sf_dir)))
    tails = F.array_compact(F.array(*(F.when(in_tail(s), F.lit(s)) for s in SKETCHED)))
    return out.drop("residue").withColumn("tails", F.when(F.col("outside_share").isNotNull(), tails)).withColumn("flagged", flagged())


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: doc_id."""
    out = scored(cut(measured(spark, sf_dir)))
    return out.where(flagged() & (F.col("outside_share") > OUTSIDE) & ~F.col("residue")).select("doc_id").distinct()


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_quantiles: language (null: the whole corpus), statistic, median, spread by the sketches."""
    wide = sketched(cut(measured(spark, sf_dir)))
    pairs = F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(f"{s}_median").alias("median"), F.col(f"{s}_spread").alias("spread")) for s in SKETCHED))
    return wide.select("language", F.inline(pairs))
