"""Public subword vocabularies: encoding, decoding, their round trip and a comparison of vocabularies.

The files are a parameter. Two forms are read: models of pieces (.model) and rank files of byte pairs (.tiktoken)."""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from sarit.functions import text as T

FOLDER = "/opt/tokenizers"
PIECES = f"{FOLDER}/piece_bpe_32k.model"
SWEPT = (PIECES, f"{FOLDER}/byte_bpe_50k.tiktoken", f"{FOLDER}/byte_bpe_multi_50k.tiktoken")
UNKNOWN = 0
# The pattern by which the public byte-pair vocabularies cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """encode, decode and the form of a text that decoding gives back."""

    def __init__(self, path: str):
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.unknown = self.model.unk_id()
            self.encode, self.decode = self.model.encode, self.model.decode
        else:
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self.model = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.unknown = -1  # bytes need none
            self.encode, self.decode = self.model.encode_ordinary, self.model.decode

    def normal(self, text: str) -> str:
        return self.model.normalize(text).replace("▁", " ").strip(" ") if self.pieces else text

    def round_trip(self, text: str) -> tuple[int, int, bool]:
        ids = self.encode(text)
        said = self.decode(ids)
        return len(ids), ids.count(self.unknown), (said.strip(" ") if self.pieces else said) == self.normal(text)


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def encoded(text: Column, path: str = PIECES) -> Column:
    """The ids of a text, null for null."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        known = vocabulary(path)
        return pa.array([None if t is None else known.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def decoded(ids: Column, path: str = PIECES) -> Column:
    """The text of ids, null for null."""

    @F.arrow_udf(StringType())
    def run(rows: pa.Array) -> pa.Array:
        known = vocabulary(path)
        return pa.array([None if r is None else known.decode(r) for r in rows.to_pylist()], pa.string())

    return run(ids)


def tripped(text: Column, path: str = PIECES) -> Column:
    """n_tokens, n_unknown, same of a text that is encoded and decoded again."""

    @F.arrow_udf(StructType([StructField("n_tokens", IntegerType()), StructField("n_unknown", IntegerType()), StructField("same", BooleanType())]))
    def run(texts: pa.Array) -> pa.Array:
        known = vocabulary(path)
        rows = [(None, None, None) if t is None else known.round_trip(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.bool_()))], ["n_tokens", "n_unknown", "same"])

    return run(text)


def round_trip(df: DataFrame, path: str = PIECES) -> DataFrame:
    """pos, n_tokens, n_unknown, same."""
    return df.select("pos", tripped(F.col("text"), path).alias("x")).select("pos", "x.*")


def sweep(df: DataFrame, paths: tuple[str, ...] = SWEPT) -> DataFrame:
    """vocabulary, tokens, fertility, unknown_share, chars_per_token of each vocabulary over all texts."""
    from sarit.operators import tokens

    text = F.col("text")
    out = None
    for path in paths:
        found = df.where("text is not null").select(tripped(text, path).alias("x"), T.n_words(text).alias("words"), F.length(text).alias("chars"))
        sums = found.agg(F.sum("x.n_tokens").alias("tokens"), F.sum("x.n_unknown").alias("unknown"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))
        part = sums.withColumn("vocabulary", F.lit(path.rpartition("/")[2]))
        out = part if out is None else out.unionByName(part)
    return tokens.sweep(out, "vocabulary")
