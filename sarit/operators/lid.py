"""A character language model for language identification: naive Bayes over runs of GRAM characters.

It is fitted on trusted samples, at most SAMPLES of each language (a documented bound of a labelled sample), and scores
whole texts row by row. Without samples there is no model, and what depends on it lets everything pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarit.functions import text as T
from sarit.functions.hashing import found

GRAM, SAMPLES = 3, 10_000


def plain(text: Column) -> Column:
    """Lower case, white space as single blanks, one on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), f"{T.WHITE}+", " ")), F.lit(" "))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of every run of GRAM characters, and how many are of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(points) - GRAM + 1, 0)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = key << np.uint64(21) | points[k : k + n]
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = row[:n] == row[GRAM - 1 :] if n else np.zeros(0, bool)
    return key[inside], np.bincount(row[:n][inside], minlength=len(texts))


class Model:
    """Log chances of runs by language, with one added to each count."""

    def __init__(self, samples: DataFrame):
        """samples: lang, text, sample_id; labels are compared without case and blanks."""
        rank = F.row_number().over(Window.partitionBy("label").orderBy("sample_id", "text"))
        rows = samples.where("text is not null and trim(lang) <> ''").withColumn("label", F.lower(F.trim("lang"))).withColumn("rank", rank).where(F.col("rank") <= SAMPLES)
        rows = rows.select("label", plain(F.col("text")).alias("text")).collect()  # SAMPLES of each language at most
        self.labels = sorted({r.label for r in rows})
        parts = [np.unique(_codes([r.text for r in rows if r.label == x])[0], return_counts=True) for x in self.labels]
        self.keys = np.unique(np.concatenate([k for k, _ in parts])) if parts else np.zeros(0, np.uint64)
        counts = np.zeros((len(self.keys), len(self.labels)))
        for i, (keys, n) in enumerate(parts):
            counts[np.searchsorted(self.keys, keys), i] = n
        total = counts.sum(0) + len(self.keys)
        self.chances = np.log((np.concatenate([counts, np.zeros((1, len(self.labels)))]) + 1) / np.where(total > 0, total, 1))

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row of log chances for each text in the form of plain()."""
        keys, sizes = _codes(texts)
        place, there = found(self.keys, keys)
        row = np.repeat(np.arange(len(texts)), sizes)
        each = self.chances[np.where(there, place, len(self.keys))]
        return np.stack([np.bincount(row, each[:, i], minlength=len(texts)) for i in range(len(self.labels))], 1)


def language_of(text: Column, model: Model) -> Column:
    """label and prob of the likeliest language; ties go to the lesser label; null for null and blank texts, and without
    a model."""

    @F.arrow_udf("struct<label: string, prob: double>")
    def scored(texts: pa.Array) -> pa.Array:
        names: list[str | None] = []
        shares: list[float | None] = []
        for start in range(0, len(texts), 256):
            part = texts.slice(start, 256).fill_null(" ").to_pylist()
            if not model.labels:
                names += [None] * len(part)
                shares += [None] * len(part)
                continue
            value = model.scores(part)
            best = value.argmax(1)
            share = 1 / np.exp(value - value.max(1)[:, None]).sum(1)
            blank = [not t.strip() for t in part]
            names += [None if b else model.labels[i] for b, i in zip(blank, best.tolist(), strict=True)]
            shares += [None if b else s for b, s in zip(blank, share.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["label", "prob"])

    return scored.asNondeterministic()(plain(text))


def with_language(df: DataFrame, model: Model) -> DataFrame:
    return df.withColumn("_language", language_of(F.col("text"), model)).withColumns({"label": F.col("_language.label"), "prob": F.col("_language.prob")}).drop("_language")


def keep(df: DataFrame, model: Model, want: Column, least: float = 0.6) -> DataFrame:
    """df with label and prob, of the texts in the wanted language with at least this probability; all without a model."""
    scored = with_language(df, model)
    return scored.where((F.col("label") == want) & (F.col("prob") >= least)) if model.labels else scored
