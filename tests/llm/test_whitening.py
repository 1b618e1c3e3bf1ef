"""Whitening against a dense eigendecomposition in whole numbers, and the merges against one SVD."""

import math

import numpy as np
import pytest

from threadloom.llm import whitening as W


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def brute(vectors, k=8):
    """(n, sums, eigenvalues, eigenvectors, trace) by whole numbers and one eigh."""
    x = [whole(v) for v in vectors]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    d = np.array([[n * a - s for a, s in zip(r, sums, strict=True)] for r in x], float) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    return n, sums, e[::-1][:k], v[:, ::-1].T[:k], float(e.sum()), x


def rows(spark, data, parts=5):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, component string, n string").repartition(parts)


def make(seed, n, d, hot=0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) * np.linspace(3, 0.2, d) + np.linspace(-2, 5, d)
    if hot:
        v[:hot] = v[0]
    return v.astype(np.float32)


@pytest.mark.parametrize(("n", "d", "hot", "parts"), [(300, 12, 100, 5), (40, 64, 0, 4), (90, 3, 0, 40), (9, 5, 0, 9)])
def test_against_eigh(spark, n, d, hot, parts):
    v = make(n, n, d, hot)
    odd = [(n, None, "", ""), (n + 1, [float("nan")] + [0.0] * (d - 1), "", ""), (n + 2, [float("inf")] * d, "", ""), (n + 3, [None] * d, "", ""), (n + 4, [], "", ""), (n + 5, [1.0] * (d + 1), "", "")]
    df = rows(spark, [(None if i == 1 else i, [float(c) for c in x], "c", "n") for i, x in enumerate(v)] + odd, parts)
    got = W.whiten(df).collect()
    m, sums, e, axes, trace, x = brute(v)
    k = min(8, d)
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {n}
    rank = min(n - 1, d)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(k):
        assert by[0, j + 1]["explained"] == pytest.approx(e[j] / trace if j < rank else 0, rel=1e-9, abs=1e-12)
        if j >= rank:
            assert all(by[None if i == 1 else i, j + 1]["whitened"] is None for i in range(n))
            continue
        want = np.array([[a - s / m for a, s in zip(r, sums, strict=True)] for r in x]) @ axes[j] / math.sqrt(e[j])
        own = np.array([by[None if i == 1 else i, j + 1]["whitened"] for i in range(n)])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-8
    assert all(by[None if i == 1 else i, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in range(n))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_merges_lose_nothing():
    v = make(4, 500, 20)
    x = np.array([whole(r) for r in v])
    all_ = W.Summary.of(x)
    for cuts in ([7, 100, 101, 490], [250], list(range(3, 500, 3))):
        parts = [W.Summary.of(p) for p in np.split(x, cuts)]
        out = parts[0]
        for p in parts[1:]:
            out = out.merged(p)
        assert out.n == 500 and out.sums == all_.sums
        assert np.allclose(out.s, all_.s, rtol=1e-12, atol=1e-9) and len(out.s) == 20
        assert np.allclose(np.abs((out.vt * all_.vt).sum(axis=1)), 1, atol=1e-10)
    big = x + 10**12  # the shift costs no digits
    assert np.allclose(W.Summary.of(big).s, all_.s, rtol=1e-12)


def test_levels_of_merges(spark):
    """Over FAN * FAN partitions there are three levels, and the result is that of one."""
    v = make(6, 600, 4)
    data = [(i, [float(c) for c in r], "", "") for i, r in enumerate(v)]
    many, one = (W.fit(rows(spark, data, p).repartition(p, "vec_id") if p > 1 else rows(spark, data, 1)) for p in (300, 1))
    assert many.n == one.n == 600 and many.sums == one.sums
    assert np.allclose(many.values, one.values, rtol=1e-12) and np.allclose(many.axes, one.axes, atol=1e-9)


def test_no_spread_and_no_rows(spark):
    same = W.whiten(rows(spark, [(i, [1.0, 2.0], "", "") for i in range(5)])).collect()
    assert len(same) == 10 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in same)
    assert W.whiten(rows(spark, [(0, None, "", ""), (1, [], "", ""), (2, [None], "", "")])).collect() == []
    assert W.whiten(rows(spark, []).limit(0)).collect() == []


def test_deviation_at_the_border_of_a_long():
    n, sums = 10, [0, 0]
    m = W.Whitening(2, n, sums, np.eye(2), np.ones(2), 2.0)
    root = math.isqrt((1 << 63) // 200)
    x = np.array([[root, root], [root + 1, root + 1], [3, 4], [1 << 50, 0]])
    dev, fits = m.deviations(x)
    exact = [sum((n * int(a)) ** 2 for a in r) for r in x]
    assert [int(d) if f else None for d, f in zip(dev, fits, strict=True)] == [e if e < 1 << 63 else None for e in exact]
