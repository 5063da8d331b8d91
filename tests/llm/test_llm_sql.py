import duckdb
import pytest

from corvane.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    frame, expected = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == sorted(repr([r[expected.columns.index(c)] for c in columns]) for r in expected.fetchall())
