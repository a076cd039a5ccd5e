"""Every query on tables with nulls, blanks, long texts, ties, repeated rows and clashing columns, and on empty ones."""

import pytest

from sarit.llm.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    rows = df.collect()
    assert df.columns
    assert rows == [] or name.endswith(("_items",))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_trouble(spark, edge, name):
    df = QUERIES[name](spark, edge)
    first = sorted(map(repr, df.collect()))
    assert len(df.columns) == len(set(df.columns))
    if name.endswith("_found"):
        assert len(first) == len(set(first))


def test_found_columns(spark, edge):
    want = {"p1": ["doc_id"], "p2": ["doc_id", "lang"], "p5": ["doc_id", "line_no"], "p6": ["row_a", "row_b"], "p7": ["tbl", "key_a", "key_b"], "p9": ["doc_id", "item_id"], "p10": ["doc_id"]}
    for name, columns in want.items():
        assert QUERIES[f"{name}_found"](spark, edge).columns == columns
    assert QUERIES["p8_ids"](spark, edge).columns == ["doc_id", "ids"]


def test_first_queries():
    """Problem 5's rows follow a plain rule; its method stands before its other queries. No other problem needs that."""
    assert [n for n in QUERIES if n.endswith("_method")] == ["p5_method"]
    assert next(n for n in QUERIES if n.startswith("p5_")) == "p5_method"


def test_sql():
    assert set(ORACLE) <= set(QUERIES) and all(isinstance(sql, str) for sql in ORACLE.values())
