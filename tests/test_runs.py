"""Runs and shifts of a thread that is cut into stretches are those of one window."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import numbering, runs


def rows():
    r = random.Random(8)
    out, at, c = [], 0, "a"
    for i in range(900):
        at += r.randint(0, 1)  # ties in time
        c = r.choice("abc") if r.random() < 0.2 else c
        out.append(("hot" if i % 2 else r.choice(["x", "y", None]), at, i, None if i % 50 == 7 else ("a" if 300 < i < 600 and i % 2 else c), r.choice(["user", "assistant"])))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "thread string, at int, id int, domain string, role string").repartition(4)


def brute():
    """({thread: runs}, shifts) by one loop over each thread."""
    found, moved = {}, []
    for t in {x[0] for x in rows()}:
        own = sorted((x for x in rows() if x[0] == t and x[3] is not None), key=lambda x: x[1:3])
        out = []
        for _, at, i, d, role in own:
            if out and out[-1][0] == d:
                out[-1][3:] = [at, out[-1][4] + 1]
            else:
                if out:
                    moved.append((t, at, i, role, out[-1][0], d))
                out.append([d, role, at, at, 1])
        found[t] = out
    return found, moved


@pytest.mark.parametrize("range_rows", [10**6, 100, 7])
def test_against_one_loop(frame, range_rows):
    found, moved = brute()
    got = runs.runs(frame, "thread", ["at", "id"], "domain", "role", range_rows=range_rows).collect()
    want = [(t, k, *run) for t, own in found.items() for k, run in enumerate(own, 1)]
    assert sorted(map(str, ((r["thread"], r["run_id"], r["category"], r["initiator_role"], r["start"], r["end"], r["n"]) for r in got))) == sorted(map(str, want))
    got = runs.shifts(frame, "thread", ["at", "id"], "domain", "role", range_rows=range_rows).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, moved))


def test_hot_thread_is_even(spark, frame):
    """A thread with half of all rows is dealt into stretches none of which is over twice the median."""
    x, cut, _ = runs._in_order(frame, "thread", ["at", "id"], "domain", 50)
    n = [r["count"] for r in x.where("thread = 'hot'").groupBy(*cut).count().collect()]
    assert len(n) >= 8 and max(n) <= 2 * sorted(n)[len(n) // 2] and max(n) <= 50
    assert runs.runs(frame.limit(0), "thread", ["at", "id"], "domain", "role").collect() == []


def test_no_stretch_without_need(frame):
    x, cut, order = runs._in_order(frame, "thread", ["at", "id"], "domain", numbering.RANGE_ROWS)
    assert cut == ["thread"] and order == ["at", "id"] and "_stretch" not in x.columns and x.where(F.col("domain").isNull()).count() == 0
