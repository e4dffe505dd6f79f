"""Every core query that has SQL gives the same rows as DuckDB over the smallest driver tables."""

import importlib
import os

import pytest

DATA = "/root/testdata/sf0.001"
AREAS = ("text", "search", "ranking", "graph", "sessions", "tables", "checks", "ingest", "build", "ask")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def _named():
    for area in AREAS:
        m = importlib.import_module(f"veldra.queries.{area}")
        for name in m.QUERIES:
            yield area, name


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize(("area", "name"), list(_named()))
def test_query(spark, duck, area, name):
    m = importlib.import_module(f"veldra.queries.{area}")
    got = m.QUERIES[name](spark, DATA).toPandas()
    if name in m.SQL:
        want = duck.execute(m.SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(tuple, got[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values))
    else:
        assert len(got.columns)


def test_entry_needs_no_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
