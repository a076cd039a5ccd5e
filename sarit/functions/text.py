"""Column expressions on text: normal forms, counts, ratios. Everything stays in the JVM but NFC, which Arrow does."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as Python's str.split() knows it, word characters as Python's \w, and control characters.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"(?U)[\s\x1c-\x1f]"  # the same as WHITE, in the form that Java matches fastest
VISIBLE = r"(?U)[\S&&[^\x1c-\x1f]]"  # its complement
WORD = r"[\p{L}\p{N}_]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}]"
# Markup left by extraction, in this order of alternatives.
INK = r"[^\t-\r\x1c-\x20]"
MARKUP = rf"<[^>]+>|&#[0-9]+;|&[a-zA-Z]+;|(?:https?://|www\.){INK}+|{INK}+@{INK}+\.{INK}+"
# The same, with mail addresses looked for only where a run of characters, or what a match left of it, begins: they
# match there if anywhere in it, and long runs cost no more than their length.
MARKUP_FAST = rf"<[^>]+>|&#[0-9]+;|&[a-zA-Z]+;|(?:https?://|www\.){INK}+|(?:\G|(?<!{INK})){INK}+@{INK}+\.{INK}+"
HANDLE = rf"(?<!{WORD})@{WORD}+"
HASH_SIGN = rf"(?<!{WORD})#(?={WORD})"
BINARY = ("JFIF", "Exif", "%PDF", "Photoshop")
NAIVE_TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
PRE_TOKEN = r"[\p{L}\p{N}_ऀ-ॣ०-ॿ]+|[^\p{L}\p{N}_ऀ-ॣ०-ॿ\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass(frozen=True)
class ScriptProfile:
    """What belongs to a corpus' script: its letters, the marks that end a line, the letters to strip (none: empty)."""

    name: str
    letters: str
    terminals: str
    foreign: str


DEVANAGARI = ScriptProfile("devanagari", r"[ऀ-ॿ]", r"[।॥?!]", r"[A-Za-z]+")
LATIN = ScriptProfile("latin", r"[A-Za-z]", r"[.?!]", "")


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode normal form C; null stays null. (Arrow's own kernel composes characters that Unicode excludes.)"""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def let(value: Column, expression) -> Column:
    """expression(value) with the value computed once; lambdas else compute it for every element."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at the ends, as Python's strip()."""
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, " ")


def drop_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def strip_markup(text: Column, handles: bool = True) -> Column:
    """Tags, entities, addresses and handles as a blank each, in one pass."""
    return F.regexp_replace(text, f"(?i){MARKUP_FAST}|{HANDLE}" if handles else f"(?i){MARKUP_FAST}", " ")


def strip_markup_in_passes(text: Column) -> Column:
    """The same patterns one after the other, which differs where they overlap; only addresses in any case."""
    for part in (r"<[^>]+>", r"&#[0-9]+;", r"&[a-zA-Z]+;", rf"(?i)(?:https?://|www\.){INK}+", rf"(?:\G|(?<!{INK})){INK}+@{INK}+\.{INK}+", HANDLE):
        text = F.regexp_replace(text, part, " ")
    return text


def drop_hash_signs(text: Column) -> Column:
    return F.regexp_replace(text, HASH_SIGN, "")


def strip_foreign(text: Column, profile: ScriptProfile = DEVANAGARI) -> Column:
    return F.regexp_replace(text, profile.foreign, " ") if profile.foreign else text


def repair_dandas(text: Column) -> Column:
    """Two pipes are a double danda, one a danda. Once the pairs are gone no two pipes are neighbours."""
    return F.regexp_replace(F.regexp_replace(text, r"\|\|", "॥"), r"\|", "।")


def collapse(text: Column) -> Column:
    """Runs of blanks and tabs as one blank, three line feeds or more as two, no white space at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(text)


def normalized(text: Column, profile: ScriptProfile = DEVANAGARI, letters=None) -> Column:
    """The whole normal form, in the order in which the parts depend on each other. letters: a function of a column that
    makes a script's letters uniform (nukta and vowel signs, say), none by default."""
    text = nfc(text)
    text = drop_zero_width(strip_controls(letters(text) if letters else text))
    text = strip_foreign(drop_hash_signs(strip_markup(text)), profile)
    return collapse(repair_dandas(text))


def norm_key(text: Column) -> Column:
    """The form in which two texts are exact duplicates."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{VISIBLE}+")).cast("bigint")


def n_naive_tokens(text: Column) -> Column:
    """Runs of word characters, and every other visible character."""
    return F.regexp_count(text, F.lit(NAIVE_TOKEN)).cast("bigint")


def n_pre_tokens(text: Column) -> Column:
    """The same with Devanagari's marks among the word characters, dandas not."""
    return F.regexp_count(text, F.lit(PRE_TOKEN)).cast("bigint")


def lines(text: Column) -> Column:
    """Lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def script_ratio(text: Column, profile: ScriptProfile = DEVANAGARI) -> Column:
    """Characters of the script among those that aren't white space, 0 without any."""
    visible, own = F.length(F.regexp_replace(text, f"{BLANK}+", "")), F.length(text) - F.length(F.regexp_replace(text, f"{profile.letters}+", ""))
    return let(F.struct(visible.alias("n"), own.alias("own")), lambda x: F.when(x["n"] > 0, x["own"] / x["n"]).otherwise(0.0))


def terminal_share(text: Column, profile: ScriptProfile = DEVANAGARI) -> Column:
    """Lines that end in a terminal mark among all that aren't blank, 0 without any."""
    return let(lines(text), lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda y: F.right(y, F.lit(1)).rlike(profile.terminals))) / F.size(x)).otherwise(0.0))


def repeated_line_share(text: Column) -> Column:
    """Lines that occur more than once among all that aren't blank, 0 without any. Equal lines are neighbours once sorted."""
    again = lambda x: F.filter(x, lambda y, i: F.coalesce(y == F.get(x, i - 1), F.lit(False)) | F.coalesce(y == F.get(x, i + 1), F.lit(False)))
    return let(F.sort_array(lines(text)), lambda x: F.when(F.size(x) > 0, F.size(again(x)) / F.size(x)).otherwise(0.0))


def looks_binary(text: Column) -> Column:
    out = F.lit(False)
    for mark in BINARY:
        out = out | text.contains(mark)
    return out


def render_digits(number: Column, script: str) -> Column:
    """A number in the digits of a script."""
    text = number.cast("string")
    return F.translate(text, "0123456789", "०१२३४५६७८९") if script == "devanagari" else text


def is_manual(manual: Column, source_type: Column) -> Column:
    """Provenance, which is recorded in either column."""
    return F.coalesce(manual, source_type == "manual", F.lit(False))


def unit_hash(text: Column, salt: str, seed: int = 1337) -> Column:
    """A number in [0, 1) that depends on the text, the salt and the seed only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(seed)), text)), 1, 15), 16, 10).cast("bigint") / float(1 << 60)
