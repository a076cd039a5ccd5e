"""Sampling, splitting and mixing by content hash, so that every run and every partitioning gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarit.functions import text as T


@dataclass(frozen=True)
class SplitParams:
    keep: float = 1.0  #: share of downloaded documents that stay
    train: float = 0.8
    val: float = 0.1
    upsample: float = 1.0  #: copies of a manual train document
    seed: int = 1337


def downsample(df: DataFrame, params: SplitParams) -> DataFrame:
    """Manual documents, and the downloaded ones whose hash is under the share to keep. Null texts are left out."""
    return df.where("text is not null").where(F.col("manual") | (T.unit_hash(F.col("text"), "keep", params.seed) < params.keep))


def split_of(text: Column, params: SplitParams) -> Column:
    h = T.unit_hash(text, "split", params.seed)
    return F.when(h < params.train, "train").when(h < params.train + params.val, "val").otherwise("test")


def assign_splits(df: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """df with split; equal texts are in one split. Null texts are left out."""
    return df.where("text is not null").withColumn("split", split_of(F.col("text"), params))


def upsample(df: DataFrame, params: SplitParams) -> DataFrame:
    """df with copy (from 0): manual train documents as often as asked, the fraction by hash; all others once."""
    whole = int(params.upsample)
    extra = (T.unit_hash(F.col("text"), "upsample", params.seed) < params.upsample - whole).cast("int")
    copies = F.when(F.col("manual") & (F.col("split") == "train"), whole + extra).otherwise(1)
    return df.withColumn("_copies", copies).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")


def combine_split(df: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """Downsampled, split and upsampled; write it with partitionBy("split")."""
    return upsample(assign_splits(downsample(df, params), params), params)


def corpus_plan(df: DataFrame, manual_share: float = 0.22) -> DataFrame:
    """One row: words of each provenance, the share of downloaded documents to keep for the wanted manual share."""
    out = df.agg(F.coalesce(F.sum(F.when(F.col("manual"), T.n_words(F.col("text")))), F.lit(0)).alias("manual_words"), F.coalesce(F.sum(F.when(~F.col("manual"), T.n_words(F.col("text")))), F.lit(0)).alias("downloaded_words"))
    keep = F.when(F.col("downloaded_words") > 0, F.least(F.lit(1.0), F.col("manual_words") * (1 - manual_share) / manual_share / F.col("downloaded_words"))).otherwise(1.0)
    return out.withColumn("keep", F.round(keep, 6)).withColumn("expected_words", F.round(F.col("manual_words") + F.col("downloaded_words") * keep).cast("bigint"))


# Characters of a token, where its number in a word has to be estimated.
CHARS_PER_TOKEN = 3.4


def corpus_plan_by_tokens(df: DataFrame, target: int, train: float = 0.8, upsample: float = 1.0, fertility: float | None = None) -> DataFrame:
    """One row: the share of downloaded documents to keep so that the train split has about `target` tokens, all manual ones
    being kept; words, tokens and manual share that this gives. Without a fertility it is estimated from the characters of
    a word."""
    words, chars = T.n_words(F.col("text")), F.length("text").cast("bigint")
    total = lambda c, which: F.coalesce(F.sum(F.when(which, c)), F.lit(0))
    manual = F.col("manual")
    out = df.agg(total(words, manual).alias("manual_words"), total(words, ~manual).alias("downloaded_words"), F.coalesce(F.sum(chars), F.lit(0)).alias("_chars"))
    known = F.lit(fertility) if fertility else F.col("_chars") / F.greatest(F.col("manual_words") + F.col("downloaded_words"), F.lit(1)) / CHARS_PER_TOKEN
    out = out.withColumn("fertility", known).withColumn("_manual", F.col("manual_words") * upsample)
    needed = F.greatest(F.lit(0.0), F.lit(float(target)) / (F.col("fertility") * train) - F.col("_manual"))
    out = out.withColumn("keep", F.when(F.col("downloaded_words") > 0, F.least(F.lit(1.0), needed / F.col("downloaded_words"))).otherwise(0.0))
    out = out.withColumn("_corpus", F.col("_manual") + F.col("downloaded_words") * F.col("keep"))
    return out.select("manual_words", "downloaded_words", F.round("fertility", 4).alias("fertility"), F.round("keep", 6).alias("keep"), F.floor("_corpus").alias("corpus_words"), F.floor(F.col("_corpus") * train * F.col("fertility")).alias("train_tokens"), F.round(F.when(F.col("_corpus") > 0, F.col("_manual") / F.col("_corpus")).otherwise(0.0), 4).alias("manual_share"))


def eval_subset(df: DataFrame, n: int = 2000, least_words: int = 128, seed: int = 1337) -> DataFrame:
    """n documents of at least so many words: those of the least hash, a uniform sample; ties by pos."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("text")))
    return df.where(T.n_words(F.col("text")) >= least_words).orderBy(order, "pos").limit(n)


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("pos").limit(n)


def window_starts(df: DataFrame, length: str, size: int, n: int, seed: int = 1337) -> DataFrame:
    """pos, k, start: n places of windows of `size` in each row of enough length, by hash."""
    rows = df.where(F.col(length) >= size).select("pos", length, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "pos", "k")), 1, 15), 16, 10).cast("bigint") / float(1 << 60)
    return rows.select("pos", "k", F.floor(unit * (F.col(length) - size + 1)).alias("start"))
