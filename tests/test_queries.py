"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillgraph.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if type(value).__name__ in ("float", "Decimal"):
        return float(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    return value


def ordered(rows):
    """Rows in an order that the last digits of floats don't change."""
    key = lambda x: (x is None, isinstance(x, str), round(x, 3) if isinstance(x, float) else x if x is not None else 0)
    return sorted(rows, key=lambda r: ([key(x) for x in r if not isinstance(x, float)], [key(x) for x in r]))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-5)
    return a == b


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, views, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.ORACLES:
        return
    relation = views.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = ordered([tuple(plain(r[k]) for k in at) for r in relation.fetchall()])
    assert len(rows) == len(want)
    for got, row in zip(ordered(rows), want, strict=True):
        assert all(same(a, b) for a, b in zip(got, row, strict=True)), (got, row)


def test_flagship(spark):
    assert registry.flagship(spark, DATA).columns == ["query_id", "rank", "node_id", "relevance"]
