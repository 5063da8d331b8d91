"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from corvane import queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = f"{FOLDER}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    expected = db.sql(queries.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect()) == sorted(repr([plain(r[p]) for p in places]) for r in expected.fetchall())


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
