"""Quantiles against DuckDB, whatever the buffer's bound: hot groups, ties, far apart values, null keys."""

import random

import pytest

from threadloom.operators import quantiles as Q

PS = {"low": 0.05, "q1": 0.25, "med": 0.5, "q66": 0.66, "top": 1.0, "least": 0.0}


def rows():
    r = random.Random(4)
    out = [("hot", r.gauss(0, 1)) for _ in range(900)] + [("ties", float(r.randint(0, 2))) for _ in range(400)] + [("one", 5.0)] * 300
    out += [("wide", r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300)) for _ in range(300)] + [("end", v) for v in (-1.7e308, 1.7e308, 0.0, 1.0)] * 40
    return out + [(None, float(i)) for i in range(50)] + [("few", 1.0), ("few", 2.0), ("nothing", None), ("hot", None)]


@pytest.mark.parametrize(("most", "bins", "passes"), [(100_000, 1_024, 12), (30, 4, 12), (30, 4, 1), (3, 1_024, 12), (1, 2, 0)])
def test_groups(spark, most, bins, passes):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table t (k varchar, v double)")
    con.executemany("insert into t values (?, ?)", rows())
    want = {w[0]: w[1:] for w in con.sql(f"select k, {', '.join(f'quantile_cont(v, {p}) as {n}' for n, p in PS.items())} from t where v is not null group by k").fetchall()}
    df = spark.createDataFrame(rows(), "k string, v double").repartition(4)
    got = {g["k"]: tuple(g[n] for n in PS) for g in Q.quantiles(df, ["k"], "v", PS, most, bins, passes).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-12)


def test_without_keys_and_rows(spark):
    df = spark.createDataFrame([(float(i % 97),) for i in range(500)], "v double")
    assert Q.quantiles(df, [], "v", {"m": 0.5}, most=10).collect()[0]["m"] == Q.quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"] == 46.5
    assert Q.quantiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []
