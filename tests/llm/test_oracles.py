"""op3, op4 and op9 against their SQL on the smallest tables."""

import os

import pytest

from threadloom.llm import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(oracles.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=key)
