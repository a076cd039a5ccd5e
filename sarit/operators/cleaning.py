"""Cleaning of documents: language filter, recurrent lines, quality reasons, exact and id duplicates.

Documents are tables with pos (the order that "first" refers to), text and source. Null texts have no words, no lines
and no ratio; each function says what becomes of them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarit.functions import text as T
from sarit.functions.hashing import found
from sarit.plans.scale import broadcast_if_small, cut
from sarit.sources.documents import not_empty

#: Most boilerplate lines, by 8 bytes each, and most frequent words that go to every executor.
MOST_LINES, MOST_WORDS = 4_000_000, 100_000


@dataclass(frozen=True)
class QualityParams:
    """Bounds of the quality filter; the defaults are those of downloaded sources."""

    min_words: int = 30
    max_words: int = 100_000
    min_script: float = 0.75
    min_terminal: float = 0.0
    max_repeated: float = 0.25
    profile: T.ScriptProfile = T.DEVANAGARI


DOWNLOADED = QualityParams()
MANUAL = QualityParams(min_words=10, min_script=0.70, max_repeated=0.30)


def quality_reason(text: Column, params: QualityParams = DOWNLOADED, manual: Column | None = None, of_manual: QualityParams = MANUAL) -> Column:
    """The first bound that a text fails, null if none; the order is the precedence. A null text is too short. Where the
    column manual is given and true, the bounds are those of manual sources."""

    def bound(name: str) -> Column:
        value = F.lit(getattr(params, name))
        return value if manual is None else F.when(manual, F.lit(getattr(of_manual, name))).otherwise(value)

    size = lambda n: F.when(F.coalesce(n, F.lit(0)) < bound("min_words"), "too_short").when(n > bound("max_words"), "too_long")
    return F.when(T.looks_binary(text), "binary_payload").otherwise(
        F.coalesce(
            T.let(T.n_words(text), size),
            F.when(T.script_ratio(text, params.profile) < bound("min_script"), "low_script_ratio")
            .when(T.terminal_share(text, params.profile) < bound("min_terminal"), "low_terminal_punct")
            .when(T.repeated_line_share(text) > bound("max_repeated"), "repetitive_lines"),
        )
    )


def with_reason(df: DataFrame, params: QualityParams = DOWNLOADED) -> DataFrame:
    return _generated(df, quality_reason(F.col("text"), params))


def with_reason_by_origin(df: DataFrame) -> DataFrame:
    """with_reason() by the bounds of manual sources where the column manual says so, else of downloaded ones."""
    return _generated(df, quality_reason(F.col("text"), DOWNLOADED, F.coalesce("manual", F.lit(False))))


def _generated(df: DataFrame, reason: Column) -> DataFrame:
    """df with the column reason. It is generated, since a filter on a computed column would be pushed to the scan, before
    the rows are spread over the cores."""
    return df.select(*(c for c in df.columns if c != "reason"), F.explode(F.array(reason)).alias("reason"))


def line_counts(df: DataFrame) -> DataFrame:
    """source, line, n: documents of the source in which the trimmed line stands; twice in one counts once."""
    return df.select("source", F.explode(F.array_distinct(T.lines(F.col("text")))).alias("line")).groupBy("source", "line").agg(F.count("*").alias("n"))


def boilerplate(df: DataFrame, share: float = 0.02) -> DataFrame:
    """source, line, n of lines in more than `share` of the source's documents, null texts among these."""
    sizes = df.groupBy("source").agg(F.count("*").alias("docs"))
    return line_counts(df).join(sizes, "source").where(F.col("n") > share * F.col("docs")).select("source", "line", "n")


def boilerplate_keys(df: DataFrame, share: float = 0.02) -> DataFrame:
    """key, a 64-bit hash of source and line, of the boilerplate lines; what is counted and shuffled are keys."""
    keys = F.transform(F.array_distinct(T.lines(F.col("text"))), lambda x: F.xxhash64("source", x))
    counts = df.select("source", F.explode(keys).alias("key")).groupBy("source", "key").agg(F.count("*").alias("n"))
    sizes = df.groupBy("source").agg(F.count("*").alias("docs"))
    return counts.join(sizes, "source").where(F.col("n") > share * F.col("docs")).select("key")


def line_keys(sources: list[str | None], rows: np.ndarray, lines: list[str]) -> np.ndarray:
    """The same keys of lines, which stand in the given rows."""
    seeds = [42 if s is None else xxhash.xxh64_intdigest(s.encode(), 42) for s in sources]
    return np.array([xxhash.xxh64_intdigest(x.encode(), seeds[r]) for r, x in zip(rows.tolist(), lines, strict=True)], np.uint64)


def strip_boilerplate(df: DataFrame, share: float = 0.02, most: int = MOST_LINES) -> DataFrame:
    """df without its boilerplate lines (blank lines stay) and without texts that this leaves empty.

    There are at most 1 / share boilerplate lines for each line of an average document. Up to `most` keys of them go to
    the executors as one sorted array, and no text is moved; of more, the documents' flagged lines come by a join."""
    hot = cut(boilerplate_keys(df, share))
    known = np.asarray(hot.limit(most + 1).toArrow().column("key")).view(np.uint64)
    few = len(known) <= most
    keys = np.sort(known) if few else None
    shared = df.sparkSession.sparkContext.broadcast(keys)

    def run(texts: pa.Array, sources: pa.Array, flags: pa.Array | None) -> pa.Array:
        whole = texts.to_pylist()
        split = [[] if t is None else t.split("\n") for t in whole]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.repeat(np.arange(len(split)), sizes)
        lines = [x.strip() for ls in split for x in ls]
        if flags is None:
            _, hit = found(shared.value, line_keys(sources.to_pylist(), rows, lines))
        else:
            known = [frozenset(f or ()) for f in flags.to_pylist()]
            keys = line_keys(sources.to_pylist(), rows, lines).view(np.int64).tolist()
            hit = np.array([k in known[r] for r, k in zip(rows.tolist(), keys, strict=True)], bool)
        hit &= np.array([x != "" for x in lines], bool)
        ends = np.cumsum(sizes)
        for r in np.unique(rows[hit]).tolist():
            drop = hit[ends[r] - sizes[r] : ends[r]]
            whole[r] = "\n".join(x for x, d in zip(split[r], drop, strict=True) if not d)
        return pa.array(whole, pa.string())

    if few:
        text = F.arrow_udf(lambda texts, sources: _in_parts(run, texts, sources), "string").asNondeterministic()(F.col("text"), F.col("source"))
        kept = df.withColumn("text", text)
    else:
        places = df.select("pos", F.explode(F.transform(F.array_distinct(T.lines(F.col("text"))), lambda x: F.xxhash64("source", x))).alias("key"))
        flags = places.join(hot, "key", "left_semi").groupBy("pos").agg(F.collect_set("key").alias("_flags"))
        text = F.arrow_udf(lambda texts, sources, flags: _in_parts(run, texts, sources, flags), "string").asNondeterministic()(F.col("text"), F.col("source"), F.col("_flags"))
        kept = df.join(flags, "pos", "left").withColumn("text", text).drop("_flags")
    return not_empty(kept.withColumn("text", T.strip(F.regexp_replace("text", r"\n{3,}", "\n\n"))))


def _in_parts(function, texts: pa.Array, sources: pa.Array, flags: pa.Array | None = None) -> pa.Array:
    """A function of columns, applied to few rows at a time, so that a batch of long texts needs no more memory."""
    parts = [function(texts.slice(i, 256), sources.slice(i, 256), None if flags is None else flags.slice(i, 256)) for i in range(0, len(texts), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def strip_manual_boilerplate(df: DataFrame) -> DataFrame:
    """strip_boilerplate() of the manual documents; the stage is left out for downloaded ones."""
    manual = F.coalesce("manual", F.lit(False))
    return strip_boilerplate(df.where(manual)).unionByName(df.where(~manual))


def first_of(df: DataFrame, key: Column, order: str = "pos") -> DataFrame:
    """The row of least `order` for each key; rows with a null key are all kept.

    A rank of 1 is planned with a group limit before the shuffle, so every task sends one row of a key at most, however
    many copies it has."""
    keyed = df.withColumn("_key", key)
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    some = keyed.where("_key is not null").withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_key")
    return some.unionByName(keyed.where("_key is null").drop("_key"))


def exact_key(text: Column) -> Column:
    """What exact duplicates agree in: 128 bits of the text's normal form."""
    return F.md5(T.norm_key(text))


def first_positions(df: DataFrame) -> DataFrame:
    """pos of the first of documents with the same normal form, by one aggregate of hashes."""
    return df.where("text is not null").groupBy(exact_key(F.col("text")).alias("_key")).agg(F.min("pos").alias("pos")).select("pos")


def copies(df: DataFrame) -> DataFrame:
    """pos of the documents that aren't the first with their text's normal form. Only hashes are counted and joined."""
    keys = cut(df.where("text is not null").select("pos", exact_key(F.col("text")).alias("_key")))
    firsts = keys.groupBy("_key").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return keys.join(firsts, "_key").where("pos > _first").select("pos")


def exact_dedup(df: DataFrame) -> DataFrame:
    """The first of documents with the same normal form, across sources. Null texts are left out. Texts are only moved if
    there are more copies than may be broadcast."""
    return df.where("text is not null").join(broadcast_if_small(cut(copies(df))), "pos", "left_anti")


def id_dedup(df: DataFrame, *keys: str) -> DataFrame:
    """The first of rows with the same id, which is the first of the keys that isn't empty; rows without one all stay."""
    return first_of(df, F.coalesce(*(F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys)))


def word_lists(words: DataFrame) -> dict[str, int] | None:
    """Lower-cased word and label of a table (lang, word), a word in several languages once for each; None if they are
    more than MOST_WORDS, which a list of frequent function words isn't."""
    rows = words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()
    return None if len(rows) > MOST_WORDS else {"labels": sorted({r.lang for r in rows}), "words": [(r.word, r.lang) for r in rows]}


def language_of(text: Column, lists: dict) -> Column:
    """label and prob: the language with the largest share of a text's frequent words, and that share; ties go to the
    lesser label, null without a frequent word."""
    labels = lists["labels"]
    of: dict[str, list[int]] = {}
    for word, label in lists["words"]:
        of.setdefault(word, []).append(labels.index(label))

    @F.arrow_udf("struct<label: string, prob: double>")
    def scored(texts: pa.Array) -> pa.Array:
        names, shares = [], []
        for text in texts:
            counts = [0] * len(labels)
            for word, n in Counter(w for w in (text.as_py() or "").lower().split() if w in of).items():
                for label in of[word]:
                    counts[label] += n
            best, every = max(counts, default=0), sum(counts)
            names.append(labels[counts.index(best)] if every else None)
            shares.append(best / every if every else None)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["label", "prob"])

    return scored.asNondeterministic()(text)


def with_language(df: DataFrame, words: DataFrame) -> DataFrame:
    """df with label and prob by frequent words of the whole text, null where there is none. Told row by row; only a list
    of more than MOST_WORDS words is joined."""
    lists = word_lists(words)
    if lists is not None:
        return df.withColumn("_language", language_of(F.col("text"), lists)).withColumns({"label": F.col("_language.label"), "prob": F.col("_language.prob")}).drop("_language")
    tokens = df.select("pos", F.explode(T.words(F.lower("text"))).alias("word")).groupBy("pos", "word").agg(F.count("*").alias("times"))
    known = words.where("lang is not null").select(F.col("lang").alias("label"), F.lower("word").alias("word")).distinct()
    hits = tokens.join(known, "word").groupBy("pos", "label").agg(F.sum("times").alias("n"))
    order = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("n"), "label"))
    best = hits.withColumn("all", F.sum("n").over(Window.partitionBy("pos"))).withColumn("rank", order).where("rank = 1")
    return df.join(best.select("pos", "label", (F.col("n") / F.col("all")).alias("prob")), "pos", "left")


def language_scores(df: DataFrame, words: DataFrame) -> DataFrame:
    """pos, label, prob of the texts with a frequent word."""
    return with_language(df.select("pos", "text"), words).where("label is not null").select("pos", "label", "prob")


def language_filter(df: DataFrame, words: DataFrame, want: Column, least: float = 0.6) -> DataFrame:
    """df with label and prob, of the documents whose best language is the wanted one with at least this probability."""
    return with_language(df, words).where((F.col("label") == want) & (F.col("prob") >= least))


def top(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(n)


def dup_groups(df: DataFrame) -> DataFrame:
    """first, copies of every group of exact duplicates."""
    groups = df.where("text is not null").groupBy(exact_key(F.col("text")).alias("key")).agg(F.min("pos").alias("first"), F.count("*").alias("copies"))
    return groups.where("copies > 1").select("first", "copies")


