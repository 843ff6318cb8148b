"""The numbered queries that SQL can state give what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from glossmill.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(expected)
