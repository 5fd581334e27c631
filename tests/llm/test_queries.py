"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from motionfield.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = c.sql(oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert rows == sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[x] for x in columns)) for r in want.fetchall())
