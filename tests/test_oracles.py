"""Every query with SQL is compared with DuckDB, and every query runs, at the smallest scale."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
TABLES = ["customer", "orders", "lineitem", "events", "embeddings", "labels", "documents", "pages", "benchmark", "conversations"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (v + 0.0 if isinstance(v, float) else str(v))
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = normal(columns, cur.fetchall())
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
    assert got, "the query gives no rows"


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
