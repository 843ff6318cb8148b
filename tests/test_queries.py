"""Every query that SQL can state gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from glossmill.plans import archive_queries, entity_queries, function_queries, lexicon_queries, message_queries, registry, text_queries  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(c[0] for c in cursor.description) == columns
    places = [[c[0] for c in cursor.description].index(c) for c in columns]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = sorted((tuple(clean(r[i]) for i in places) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(clean(r[c]) for c in columns) for r in found.collect()), key=str) == expected
