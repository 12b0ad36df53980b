"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest

from logstrata.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    order = lambda row: tuple((x is None, x) for x in row)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=order)
    assert rows == sorted(want.select(*columns).fetchall(), key=order)
