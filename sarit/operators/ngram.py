"""An n-gram language model by hashed counts, and the perplexity filter on it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarit.functions import text as T
from sarit.functions.hashing import found, stirred, word_hashes
from sarit.operators.quantiles import quantiles
from sarit.plans.arrow import chunks, map_text, ragged
from sarit.plans.scale import cut

#: Most entries of a model that go to every executor, of 16 bytes each.
MOST_ENTRIES = 2_000_000
#: Entries that a task adds up before it passes them on, and rows of a batch that it passes on.
HELD, SENT = 1_000_000, 50_000


@dataclass(frozen=True)
class PerplexityParams:
    """max_docs and max_tokens bound the training text (in order of pos), max_words what is scored of a text,
    cutoff_sample the documents of the percentile; None, the default, is no bound. least: counts of pairs up to this are
    pruned; backoff: factor of an unseen pair; max_perplexity: an absolute cutoff in place of the percentile."""

    max_docs: int | None = None
    max_tokens: int | None = None
    max_words: int | None = None
    least: int = 1
    backoff: float = 0.4
    percentile: float = 0.95
    cutoff_sample: int | None = None
    max_perplexity: float | None = None


# The bounds of the published pipeline, a preset that no query uses.
BOUNDED = PerplexityParams(max_docs=400_000, max_tokens=20_000_000, max_words=300, cutoff_sample=200_000)


def running_total(df: DataFrame, order: str, value: str, cells: int = 1024) -> DataFrame:
    """df with `before`, the sum of `value` over the rows of lower `order`; order values are unique.

    The range of `order` is cut into cells whose sums are added up first, so no window ever holds all rows."""
    ends = df.agg(F.min(order).alias("_low"), F.max(order).alias("_high"))  # one row
    celled = df.crossJoin(F.broadcast(ends)).withColumn("_cell", F.floor((F.col(order) - F.col("_low")) * cells / (F.col("_high") - F.col("_low") + 1))).drop("_low", "_high")
    sums = celled.groupBy("_cell").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_cell", earlier.alias("_start"))  # at most `cells` rows
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return celled.join(F.broadcast(starts), "_cell").withColumn("before", F.col("_start") + inside).drop("_cell", "_start")


def training_documents(df: DataFrame, params: PerplexityParams = PerplexityParams()) -> DataFrame:
    """pos, text of the documents that the model is trained on: the budget ends after the one that reaches it."""
    texts = df.where("text is not null").select("pos", "text")
    if params.max_docs is None and params.max_tokens is None:
        return texts
    sized = texts.select("pos", T.n_words(F.col("text")).alias("n"), F.lit(1).alias("one"))
    if params.max_docs is not None:
        sized = running_total(sized, "pos", "one").where(F.col("before") < params.max_docs).drop("before")
    if params.max_tokens is not None:
        sized = running_total(sized, "pos", "n").where(F.col("before") < params.max_tokens)
    return texts.join(cut(sized.select("pos")), "pos", "left_semi")


def ngrams(documents: DataFrame, order: int, least: int = 0) -> DataFrame:
    """words, n of runs of `order` neighbouring words of documents (text), those of more than `least`."""
    tokens = documents.where("text is not null").select(T.words(F.col("text")).alias("tokens")).where(F.size("tokens") >= order)
    runs = F.transform(F.sequence(F.lit(0), F.size("tokens") - order), lambda i: F.array(*(F.get("tokens", i + k) for k in range(order))))
    return tokens.select(F.explode(runs).alias("words")).groupBy("words").agg(F.count("*").alias("n")).where(F.col("n") > least)


def unigrams(documents: DataFrame) -> DataFrame:
    """word, n."""
    return documents.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bigrams(documents: DataFrame, least: int = 1) -> DataFrame:
    """first, second, n of neighbouring words, without rare ones."""
    return ngrams(documents, 2, least).select(F.col("words")[0].alias("first"), F.col("words")[1].alias("second"), "n")


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return stirred(stirred(first) + second)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and their counts, pairs, their first words and counts, of some texts."""
    hashes, sizes = word_hashes(texts, lower=False)
    one, n_one = np.unique(hashes, return_counts=True)
    inside = np.ones(max(len(hashes) - 1, 0), bool)
    ends = np.cumsum(sizes)[:-1]
    inside[ends[(ends > 0) & (ends < len(hashes))] - 1] = False
    two, at, n_two = np.unique(_pair(hashes[:-1], hashes[1:])[inside], return_index=True, return_counts=True)
    return one, n_one, two, hashes[:-1][inside][at], n_two


def _counts(batches):
    """order, key, context, n: the distinct words and pairs of a partition, added up in blocks of about HELD entries; the
    context of a pair is its first word."""
    held: list[tuple] = []

    def added():
        one, n_one, two, context, n_two = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        words, place = np.unique(one, return_inverse=True)
        pairs, first, where = np.unique(two, return_index=True, return_inverse=True)
        order = np.repeat(np.array([1, 2], np.int32), (len(words), len(pairs)))
        key, of = np.concatenate([words, pairs]).view(np.int64), np.concatenate([words, context[first]]).view(np.int64)
        n = np.concatenate([np.bincount(place, n_one, minlength=len(words)), np.bincount(where, n_two, minlength=len(pairs))]).astype(np.int64)
        for i in range(0, len(key), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + SENT]) for x in (order, key, of, n)], ["order", "key", "context", "n"])

    for batch in batches:
        for part in chunks(batch, "text"):
            held.append(_counted(part.column("text").to_pylist()))
            if sum(len(x[0]) + len(x[2]) for x in held) >= HELD:
                yield from added()
    if held:
        yield from added()


class Model:
    """Counts of words and log chances of pairs, by 64-bit keys. The entries of highest count, at most `most` of them, go
    to the executors as sorted arrays; what is beyond, rare by then, stays a table and is joined."""

    def __init__(self, documents: DataFrame, params: PerplexityParams = PerplexityParams(), most: int = MOST_ENTRIES):
        self.params = params
        counts = documents.where("text is not null").select("text").mapInArrow(_counts, "order int, key bigint, context bigint, n bigint")
        counts = cut(counts.groupBy("order", "key").agg(F.first("context").alias("context"), F.sum("n").alias("n")).where((F.col("order") == 1) | (F.col("n") > params.least)))
        words = counts.where("order = 1").select("key", "n")
        self.total, self.kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        chance = F.log(F.col("n") / F.col("of"))
        pairs = counts.where("order = 2").join(words.select(F.col("key").alias("context"), F.col("n").alias("of")), "context").select("order", "key", "n", chance.alias("chance"))
        self.entries = cut(words.select(F.lit(1).alias("order"), "key", "n", F.lit(None).cast("double").alias("chance")).unionByName(pairs))
        bits = {r.bits: r.n for r in self.entries.groupBy(F.floor(F.log2("n")).alias("bits")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
        self.least, held = 0, 0
        for b in sorted(bits, reverse=True):
            held += bits[b]
            if held > most:
                self.least = 1 << (b + 1)
                break
        hot = self.entries.where(F.col("n") >= self.least).toArrow()  # at most `most` rows
        self.complete = self.least == 0
        order, key = np.asarray(hot.column("order")), np.asarray(hot.column("key")).view(np.uint64)
        parts = []
        for which, value in ((1, np.asarray(hot.column("n")).astype(np.float64)), (2, np.asarray(hot.column("chance")).astype(np.float64))):
            mine = np.flatnonzero(order == which)
            mine = mine[np.argsort(key[mine])]
            parts += [key[mine], value[mine]]
        self.shared = documents.sparkSession.sparkContext.broadcast(parts)

    def _places(self):
        """A function of texts: log chances of all places (nan where the tables beyond have to tell), the words' numbers
        of occurrences (nan likewise), hashes, pair keys and sizes."""
        shared, total, complete, backoff, longest = self.shared, self.total + self.kinds, self.complete, math.log(self.params.backoff), self.params.max_words

        def places(texts: list[str]):
            words, n_words, pairs, chances = shared.value
            hashes, sizes = word_hashes(texts, lower=False)
            if longest is not None:
                row = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hashes, sizes = hashes[row < longest], np.minimum(sizes, longest)
            before = np.concatenate([np.zeros(min(len(hashes), 1), np.uint64), hashes[:-1]])
            start = (np.cumsum(sizes) - sizes)[sizes > 0]
            keys = _pair(before, hashes)
            at, there = found(words, hashes)
            seen = np.where(there, n_words[at] if len(words) else 0.0, 0.0 if complete else np.nan)
            out = backoff + np.log((seen + 1) / total)
            at, paired = found(pairs, keys)
            paired[start] = False
            first = np.zeros(len(hashes), bool)
            first[start] = True
            if not complete:
                out[~paired & ~first] = np.nan
            out[paired] = chances[at[paired]] if len(pairs) else 0.0
            return out, seen, first, hashes, keys, sizes

        return places

    def column(self, text: Column) -> Column:
        """The perplexity of a text as a column; of a complete model only."""
        places = self._places()

        @F.arrow_udf("double")
        def perplexity(texts: pa.Array) -> pa.Array:
            out = []
            for start in range(0, len(texts), 512):
                part = texts.slice(start, 512)
                value, _, _, _, _, sizes = places(part.fill_null("").to_pylist())
                row = np.repeat(np.arange(len(part)), sizes)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(sizes > 0, np.exp(-np.bincount(row, value, minlength=len(part)) / np.maximum(sizes, 1)), np.inf)
                out.append(pa.array(score, mask=np.asarray(part.is_null())))
            return pa.concat_arrays(out) if out else pa.array([], pa.float64())

        return perplexity.asNondeterministic()(text)  # else a filter on it computes it twice

    def scores(self, df: DataFrame) -> DataFrame:
        """pos, perplexity of all texts of df; infinite for a text without words, null texts have none."""
        texts = df.where("text is not null").select("pos", "text")
        if self.complete:
            return texts.select("pos", self.column(F.col("text")).alias("perplexity"))
        places = self._places()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            value, seen, first, hashes, keys, sizes = places(batch.column("text").to_pylist())
            row = np.repeat(np.arange(len(sizes)), sizes)
            open_ = np.isnan(value)
            known = np.bincount(row[~open_], value[~open_], minlength=len(sizes)).astype(np.float64)  # integers if there is none
            rest = np.flatnonzero(open_)
            lists = [ragged(x, np.bincount(row[rest], minlength=len(sizes)), kind) for x, kind in ((np.where(first[rest], np.uint64(0), keys[rest]).view(np.int64), pa.int64()), (hashes[rest].view(np.int64), pa.int64()), (seen[rest], pa.float64()))]
            return pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(known), pa.array(sizes), *lists], ["pos", "known", "n", "pair", "word", "seen"])

        scored = cut(map_text(texts, run, "pos bigint, known double, n bigint, pair array<bigint>, word array<bigint>, seen array<double>"))
        rest = scored.select("pos", F.explode(F.arrays_zip("pair", "word", "seen")).alias("x")).select("pos", "x.*").groupBy("pos", "pair", "word", "seen").agg(F.count("*").alias("times"))
        beyond = self.entries.where(F.col("n") < self.least)
        rest = rest.join(beyond.where("order = 2").select(F.col("key").alias("pair"), "chance"), "pair", "left").join(beyond.where("order = 1").select(F.col("key").alias("word"), F.col("n").cast("double").alias("rare")), "word", "left")
        seen = F.when(F.isnan("seen"), F.coalesce("rare", F.lit(0.0))).otherwise(F.col("seen"))
        value = F.coalesce("chance", math.log(self.params.backoff) + F.log((seen + 1) / (self.total + self.kinds)))
        sums = rest.groupBy("pos").agg(F.sum(value * F.col("times")).alias("more"))
        whole = scored.select("pos", "known", "n").join(sums, "pos", "left")
        return whole.select("pos", F.when(F.col("n") == 0, float("inf")).otherwise(F.exp(-(F.col("known") + F.coalesce("more", F.lit(0.0))) / F.col("n"))).alias("perplexity"))


def cutoff(scores: DataFrame, params: PerplexityParams = PerplexityParams()) -> float | None:
    """The absolute limit if there is one, else the percentile of the finite perplexities, of every so many-th in order
    of pos if there are more than cutoff_sample; None without any."""
    if params.max_perplexity is not None:
        return params.max_perplexity
    if params.cutoff_sample is not None:
        step = max(1, scores.count() // params.cutoff_sample)
        if step > 1:
            scores = running_total(scores.withColumn("one", F.lit(1)), "pos", "one").where(F.col("before") % step == 0)
    return quantiles(scores, "perplexity", [params.percentile])[0]


def perplexity_filter(df: DataFrame, reference: DataFrame | None = None, params: PerplexityParams = PerplexityParams()) -> DataFrame:
    """df with perplexity, up to the cutoff. The model is of the reference, df itself if there is none or it has no
    words; a model without words lets all pass, with a null perplexity. Texts are neither shuffled nor joined unless the
    model is too large for the executors."""
    model = Model(training_documents(df if reference is None else reference, params), params)
    if reference is not None and not model.total:
        model = Model(training_documents(df, params), params)
    if not model.total:
        return df.withColumn("perplexity", F.lit(None).cast("double"))
    scores = cut(model.scores(df))
    limit = cutoff(scores, params)
    if limit is None:
        return df.withColumn("perplexity", F.lit(None).cast("double")).limit(0)
    if model.complete:
        return df.where("text is not null").withColumn("perplexity", model.column(F.col("text"))).where(F.col("perplexity") <= limit * (1 + 1e-12))
    return df.join(scores.where(F.col("perplexity") <= limit * (1 + 1e-12)), "pos")
