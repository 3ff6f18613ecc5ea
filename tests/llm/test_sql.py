"""Corpus queries with SQL, against DuckDB on the smallest tables."""

import os

import pytest

from barsmith.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("BARS_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want) and want
