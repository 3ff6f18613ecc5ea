"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import pytest

from barsmith.plans import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("BARS_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    return c


def plain(rows):
    fix = lambda v: None if v is None or v != v else float(v) if isinstance(v, float) else v if isinstance(v, str) else int(v)
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    cursor = duck.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({SQL[name]})")
    assert plain(got.select(*names).collect()) == plain(cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
