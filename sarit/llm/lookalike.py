"""Problem 7: visually identical text with different characters.

Method: the confusables skeleton. A text is decomposed, every character is replaced by its prototype from a
look-alike table, and the result is decomposed again; texts with equal skeletons look the same. The same table,
after lower-casing and without punctuation, gives the words that the leak and the overlap operators compare.

Null texts have no skeleton and are in no pair. Texts without a visible character (empty, blank, only invisible
characters) are no cases. Exact copies are no pair; a pair needs two different strings. Rows that occur twice under
one key make no pair with themselves. Columns other than the key and the text don't matter.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.plans.arrow import map_text
from sarit.plans.scale import cut, spread, table

# Letters that common fonts draw like an ASCII letter.
LETTERS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ү": "y", "Ӏ": "I", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ι": "ı", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Armenian, Latin
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Տ": "S", "Ս": "U", "Օ": "O", "ց": "g", "ɑ": "a", "ɡ": "g", "ǀ": "|", "ı": "ı",
    # Kelvin and angstrom signs decompose by themselves
}
# Signs that are drawn alike.
SIGNS = {
    "।": "|", "∣": "|", "│": "|", "❘": "|", "॥": "||", "‖": "||", "∥": "||", "║": "||", "ǁ": "||",
    "ः": ":", "∶": ":", "ː": ":", "։": ":", "׃": ":", "꞉": ":",
    "‐": "-", "‑": "-", "−": "-", "⁃": "-", "˗": "-", "‒": "–",
    "’": "’", "ʼ": "’", "ʹ": "′", "‚": ",", "․": ".", "∙": "·", "⋅": "·", "・": "·", "•": "•", "⁄": "/", "∕": "/", "∼": "~", "ꓸ": ".",
}
# Devanagari letters and signs that can be put together from others.
BUILT = {
    "आ": "अा", "ऑ": "अॉ", "ऒ": "अॊ", "ओ": "अो", "औ": "अौ", "ऄ": "अॆ", "ॲ": "अॅ", "ऍ": "एॅ", "ऎ": "एॆ", "ऐ": "एे", "ई": "र्इ",
    "ऊ": "उु", "ॉ": "ाॅ", "ॊ": "ाॆ", "ो": "ाे", "ौ": "ाै", "ँ": "ॅं",
}

#: Between joined texts; a noncharacter, which no text may hold.
MARK = "\U0010ffff"
_INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
_SAME_WIDTHS = ("<wide>", "<narrow>", "<noBreak>")


@cache
def _tables() -> tuple[np.ndarray, dict[str, str], np.ndarray]:
    """Code point to prototype (0: dropped), the prototypes of several characters, code point to letter of a word
    (lower case, 0 dropped, space for all that is no letter, mark or number)."""
    one = np.arange(0x110000, dtype=np.uint32)
    several: dict[str, str] = {}
    for code in range(0x110000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind in ("Cf", "Cc") and ch not in "\t\n\v\f":
            one[code] = 0
        elif kind == "Zs" or ch in "\t\v\f":
            one[code] = 32
        elif kind in ("Zl", "Zp"):
            one[code] = 10
        else:
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            same = tag in _SAME_WIDTHS or tag == "<compat>" and (0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06 or 0x01C4 <= code <= 0x01F3 or code in (0x2025, 0x2026, 0x00B5, 0x0132, 0x0133))
            if same:
                to = unicodedata.normalize("NFKD", ch)
                if len(to) == 1:
                    one[code] = ord(to)
                else:
                    several[ch] = to
    one[0x85] = 10
    one[_INVISIBLE] = 0
    for known in (LETTERS, SIGNS):
        for ch, to in known.items():
            if len(to) == 1:
                one[ord(ch)] = ord(to)
            else:
                several[ch] = to
    several |= BUILT
    one = np.where(one < 0x110000, one[np.minimum(one, 0x10FFFF)], one)  # full-width look-alikes reach their prototypes too
    one[0x10FFFF] = 0x10FFFF
    word = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        proto = int(one[code])
        if proto == 0:
            word[code] = 0
            continue
        kind = unicodedata.category(chr(proto))
        if kind[0] in "LMN":
            low = chr(proto).lower()
            word[code] = one[ord(low)] if len(low) == 1 else proto
    word[ord("ः")] = 32  # a colon's double, so punctuation
    word[0x10FFFF] = 0x10FFFF
    return one, several, word


@cache
def _plain_table() -> np.ndarray:
    """The prototypes, Devanagari as it is."""
    out = _tables()[0].copy()
    out[0x900:0x980] = np.arange(0x900, 0x980)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _decomposed(texts: list[str]) -> str:
    joined = MARK.join(t.replace(MARK, "") if MARK in t else t for t in texts)
    return unicodedata.normalize("NFD", joined.replace("\r\n", "\n"))


def skeletons(texts: list[str]) -> list[str]:
    """The skeleton of each text. Spaces at line ends are dropped, runs of spaces are one space."""
    if not texts:
        return []
    one, several, _ = _tables()
    text = _decomposed(texts)
    for ch, to in several.items():
        if ch in text:
            text = text.replace(ch, to)
    codes = one[_codes(text)]
    codes = codes[codes != 0]
    blank = (codes == 32) | (codes == 10) | (codes == 0x10FFFF)
    space = codes == 32
    drop = np.zeros(len(codes), bool)
    drop[1:] |= space[1:] & blank[:-1]
    codes = codes[~drop]
    follows = np.append(codes[1:], 0x10FFFF)
    codes = codes[~((codes == 32) & ((follows == 10) | (follows == 0x10FFFF)))]
    text = unicodedata.normalize("NFD", codes.tobytes().decode("utf-32-le"))
    return [t.strip("\n ") for t in text.split(MARK)]


def plain_forms(texts: list[str]) -> list[str]:
    """Each text decomposed, with one form of look-alike letters and widths and without invisible characters, but
    with its own dandas and Devanagari letters, so that patterns (decomposed too) can be searched in it."""
    if not texts:
        return []
    text = _decomposed(texts)
    codes = _plain_table()[_codes(text)]
    text = codes[codes != 0].tobytes().decode("utf-32-le")
    for whole, parts in BUILT.items():
        if parts in text:
            text = text.replace(parts, whole)
    return text.split(MARK)


def word_texts(texts: list[str]) -> list[str]:
    """Each text as its words between single or several spaces: no case, punctuation, line breaks, invisible
    characters, one form of look-alikes."""
    if not texts:
        return []
    _, several, word = _tables()
    text = _decomposed(texts)
    for ch, to in several.items():
        if to.isalpha() or unicodedata.category(ch)[0] in "LM":
            if ch in text:
                text = text.replace(ch, to)
    codes = word[_codes(text)]
    return codes[codes != 0].tobytes().decode("utf-32-le").split(MARK)


def _hashes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    batch = batch.filter(batch.column("text").is_valid())
    texts = batch.column("text").to_pylist()
    looks = skeletons(texts)
    rows = [i for i, s in enumerate(looks) if s]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("tbl").take(pa.array(rows, pa.int64())),
            batch.column("key").take(pa.array(rows, pa.int64())),
            pa.array([xxhash.xxh3_128_digest(looks[i].encode()) for i in rows], pa.binary()),
            pa.array([xxhash.xxh3_128_digest(texts[i].encode()) for i in rows], pa.binary()),
        ],
        ["tbl", "key", "look", "string"],
    )


def look_hashes(df: DataFrame) -> DataFrame:
    """Of a table (tbl, key, text): tbl, key, 128-bit hashes of skeleton and string, for texts with a visible character."""
    return map_text(spread(df.select("tbl", "key", "text")), _hashes, "tbl string, key bigint, look binary, string binary")


def mixed_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, look, string of the documents whose look several different strings have."""
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("key"), "text")
    found = cut(look_hashes(documents)).drop("tbl")
    mixed = found.groupBy("look").agg(F.min("string").alias("low"), F.max("string").alias("high")).where("low <> high").select("look")
    return cut(found.join(mixed, "look"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_classes: key (doc_id), class, string, n_links: the documents that look like another with a different string: a class
    for each look, named by its least doc_id, a number for each of its strings by its least doc_id, and to how many documents
    it is linked. No pairs are made."""
    some = mixed_looks(spark, sf_dir)
    strings = some.groupBy("look", "string").agg(F.min("key").alias("first"), F.count_distinct("key").alias("n"))
    looks = strings.groupBy("look").agg(F.min("first").alias("class"), F.sum("n").alias("all"))
    out = some.distinct().join(strings, ["look", "string"]).join(looks, "look")
    return out.select("key", "class", F.col("first").alias("string"), (F.col("all") - F.col("n")).alias("n_links"))


def same_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, key_a, key_b of texts that look the same but aren't the same string.

    Only the distinct strings of one look are paired, and the copies joined to them after that, so a string with
    very many copies meets itself nowhere. classes() tells the same without pairs.
    """
    some = mixed_looks(spark, sf_dir)
    kinds = some.select("look", "string").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("string", "other"), "look").where(F.col("string") < F.col("other")).select("string", "other")
    members = some.select("string", F.col("key").alias("a"))
    whole = pairs.join(members, "string").join(members.select(F.col("string").alias("other"), F.col("a").alias("b")), "other").where("a <> b")
    by_document = whole.select(F.lit("documents").alias("tbl"), F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = batch.column("generated").to_pylist(), batch.column("text").to_pylist()
        keep = [i for i, (a, b, x, y) in enumerate(zip(one, two, skeletons([t or "" for t in one]), skeletons([t or "" for t in two]), strict=True)) if a is not None and b is not None and a != b and x and x == y]
        return pa.RecordBatch.from_arrays([batch.column("score_id").take(pa.array(keep, pa.int64()))], ["key"])

    scored = table(spark, sf_dir, "scored_examples", "score_id", "generated", F.col("gold").alias("text"))
    by_example = map_text(spread(scored), compare, "key bigint").distinct()
    return by_document.unionByName(by_example.select(F.lit("scored_examples").alias("tbl"), F.col("key").alias("key_a"), F.col("key").alias("key_b")))


def one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, key, field and form: the skeleton of each documents.text, scored_examples.generated and scored_examples.gold,
    null for null; equal-looking texts have equal forms."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        looks = skeletons([t or "" for t in texts])
        form = pa.array([None if t is None else s for t, s in zip(texts, looks, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tbl", "key", "field")), form], ["tbl", "key", "field", "form"])

    def forms(name: str, key: str, *fields: str) -> DataFrame:
        values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("value")
        rows = spread(table(spark, sf_dir, name, key, *fields)).select(F.lit(name).alias("tbl"), F.col(key).alias("key"), values)
        return map_text(rows.select("tbl", "key", "value.*"), run, "tbl string, key bigint, field string, form string")

    return forms("documents", "doc_id", "text").unionByName(forms("scored_examples", "score_id", "generated", "gold"))
