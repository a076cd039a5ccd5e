"""Text expressions on hand-made rows, each with a plain statement of the rule."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sarit.functions import text as T

ROWS = ["खाया। गया!", "a\x01b", "a​b", "x &amp; #tag @user http://h/p y", "a|b||c|||d", "a\n\n\n\nb", " a b　c ", "é", "<b>x</b> &#12; mail a@b.co end", "", " ", None, "%PDF-1.4 x", "one\none\ntwo।"]


def column(spark, expression, rows=ROWS):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").select("i", expression.alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_counts(spark):
    text = F.col("text")
    assert column(spark, T.n_words(text)) == [None if t is None else len(t.split()) for t in ROWS]
    assert column(spark, T.n_naive_tokens(text)) == [None if t is None else len(re.findall(r"\w+|[^\w\s]", t)) for t in ROWS]
    assert column(spark, T.n_pre_tokens(text)) == [None if t is None else len(re.findall(r"[\wऀ-ॣ०-ॿ]+|[^\w\s]", t)) for t in ROWS]
    assert column(spark, T.n_naive_tokens(text))[0] == 8 and column(spark, T.n_pre_tokens(text))[0] == 4


def test_forms(spark):
    text = F.col("text")
    assert column(spark, T.strip_controls(text))[1] == "a b"
    assert column(spark, T.drop_zero_width(text))[2] == "ab"
    assert column(spark, T.repair_dandas(text))[4] == "a।b॥c॥।d"
    assert column(spark, T.collapse(text))[5] == "a\n\nb"
    assert column(spark, T.nfc(text)) == [None if t is None else unicodedata.normalize("NFC", t) for t in ROWS]
    assert column(spark, T.norm_key(text)) == [None if t is None else " ".join(t.split()) for t in ROWS]
    assert column(spark, T.strip_markup(text))[3].split() == ["x", "#tag", "y"]
    assert column(spark, T.strip_markup(text))[8].split() == ["x", "mail", "end"]
    assert column(spark, T.drop_hash_signs(text))[3].split()[2] == "tag"
    assert column(spark, T.strip_foreign(text, T.LATIN)) == ROWS
    assert column(spark, T.strip_markup_in_passes(text))[3].split() == ["x", "#tag", "y"]


def test_ratios(spark):
    text = F.col("text")
    assert column(spark, T.script_ratio(text))[9:12] == [0.0, 0.0, 0.0]
    assert column(spark, T.terminal_share(text))[13] == pytest.approx(1 / 3)
    assert column(spark, T.repeated_line_share(text))[13] == pytest.approx(2 / 3)
    assert column(spark, T.looks_binary(text))[12] is True


def test_digits_and_provenance(spark):
    df = spark.createDataFrame([(409, True, None), (10, None, "manual"), (7, None, None)], "n int, manual boolean, source_type string")
    got = df.select(T.render_digits(F.col("n"), "devanagari").alias("d"), T.is_manual(F.col("manual"), F.col("source_type")).alias("m")).collect()
    assert [(r.d, r.m) for r in got] == [("४०९", True), ("१०", True), ("७", False)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab |।\n\t​é&;<>@#.कि १", max_size=30), min_size=1, max_size=20))
def test_normal_forms_are_stable(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    once = df.select(T.collapse(T.repair_dandas(T.drop_zero_width(T.strip_controls(T.nfc(F.col("text")))))).alias("text"))
    again = once.select("text", T.collapse(T.repair_dandas(T.drop_zero_width(T.strip_controls(T.nfc(F.col("text")))))).alias("again"))
    assert all(r.text == r.again for r in again.collect())
    assert [r.k for r in df.select(T.norm_key(F.col("text")).alias("k")).collect()] == [" ".join(t.split()) for t in texts]
