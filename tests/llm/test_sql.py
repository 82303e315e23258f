"""Queries of the subpackage against their SQL in DuckDB."""

import duckdb
import pytest

from quillgraph.llm import catalog

TABLES = "documents", "pages"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    got = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    wanted = con.sql(catalog.ORACLES[name])
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows and sorted(rows, key=str) == sorted(con.sql(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall(), key=str)
