"""Trends of markers against their SQL on messages made for it."""

import duckdb
import pytest

from threadloom.plans import catalog

NO_TEXT = 3


def message(i):
    """User messages whose rates by phrase and by single word rank the months differently; marks join to no word, and one month has no text."""
    month = i % 8
    text = " ".join(["of the"] * (8 - month) + ["Is"] * (month % 3 + i % 2) + ["thé der_ x"] + ["der"] * (month % 5 == 4) + ["iś"] * (3 * (month == 6)))
    return i, 0, "user", None if month == NO_TEXT or i % 11 == 7 else text


def test_marker_trend_counts_what_its_sql_counts(spark, tmp_path):
    rows = [message(i) for i in range(160)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["marker_trend_shuffle"])
    want = {r["marker"]: r for r in (dict(zip(want.columns, row, strict=True)) for row in want.fetchall())}
    got = {r["marker"]: r.asDict() for r in catalog.QUERIES["marker_trend_shuffle"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) == {"system", "relational", "uncertainty"}
    for marker, row in want.items():
        for column, value in row.items():
            assert got[marker][column] == (value if isinstance(value, str) or value is None or value != value else pytest.approx(value, abs=1.5e-6))
