"""Every query of the core with SQL agrees with it on the smallest tables; every other gives rows of a stable schema."""

import decimal
import os

import pytest

import __spark_entry__
from sarit.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return None if value is None else repr(value + 0.0) if isinstance(value, float) else str(value)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
        assert rows == want


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
