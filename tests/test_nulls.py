"""Null models drawn from counts, and k-means of many settings and starts, against plain Python."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from threadloom.operators import lloyd, resample
from threadloom.plans import catalog


def test_hypergeometric_by_inversion():
    r = random.Random(1)
    for total, marked, drawn in [(10, 4, 3), (60, 30, 30), (200, 3, 150), (7, 7, 2), (5, 0, 5), (9, 5, 9), (400, 180, 77)]:
        low, high = max(0, drawn - (total - marked)), min(marked, drawn)
        p = [Fraction(math.comb(marked, k) * math.comb(total - marked, drawn - k), math.comb(total, drawn)) for k in range(low, high + 1)]
        for u in [0.0, 0.5, 0.999999, *(r.random() for _ in range(50))]:
            k, sum_ = low, p[0]
            while sum_ <= Fraction(u) and k < high:
                k += 1
                sum_ += p[k - low]
            assert resample.hypergeometric(u, total, marked, drawn) == k
    # Billions of rows: the mean and the deviation are those of the distribution.
    draws = [resample.hypergeometric(r.random(), 4 * 10**9, 10**9, 2 * 10**9) for _ in range(60)]
    mean, sd = 5 * 10**8, math.sqrt(2e9 * 0.25 * 0.75 * 0.5)
    assert abs(np.mean(draws) - mean) < 5 * sd / 60**0.5 and 0.6 * sd < np.std(draws) < 1.5 * sd


ROWS = [(f"2025-{5 + i % 8:02}", ("user", "assistant")[i % 5 == 0], (i * i + i // 7) % 4) for i in range(600)]


def counts(spark, rows=ROWS, **more):
    c = Counter(rows)
    return spark.createDataFrame([(*k, n, *more.values()) for k, n in c.items()], "month string, role string, cluster int, n long" + "".join(f", {m} int" for m in more))


def test_margins_are_kept(spark):
    month, role, cell = (Counter(f(r) for r in ROWS) for f in (lambda r: r[0], lambda r: r[:2], lambda r: r[1:]))
    drawn = resample.null_tables(counts(spark), "month", "role", "cluster", 5)
    got = {m: [r.asDict() for r in x.collect()] for m, x in drawn.items()}
    for p in range(5):
        own = {m: [r for r in x if r["perm_id"] == p] for m, x in got.items()}
        total = lambda rows, *keys: Counter({k: n for k, n in _sums(rows, keys).items() if n})
        assert total(own["months"], "month") == {(k,): n for k, n in month.items()}
        assert total(own["months"], "role", "cluster") == {(a, str(b)): n for (a, b), n in cell.items()}
        assert total(own["roles"], "month", "role") == dict(role)
        assert total(own["roles"], "month", "cluster") == {(m, str(c)): sum(1 for r in ROWS if r[0] == m and r[2] == c) for m, c in {(r[0], r[2]) for r in ROWS}}
        floor = {k: min(n for (_, r), n in role.items() if r == k) for k in ("user", "assistant")}
        assert total(own["volume"], "month", "role") == {k: floor[k[1]] for k in role}
    again = resample.null_tables(counts(spark).repartition(7), "month", "role", "cluster", 5)["months"].collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn["months"].collect()))
    assert all(x.collect() == [] for x in resample.null_tables(counts(spark).limit(0), "month", "role", "cluster", 3).values())


def _sums(rows, keys):
    out = defaultdict(int)
    for r in rows:
        out[tuple(r[k] for k in keys)] += r["n"]
    return out


def measures(rows):
    """{month: (entropy of user, divergence)} of {(month, role, cluster): n}."""
    out = {}
    for m in sorted({k[0] for k in rows}):
        side = {s: {c: n for (m2, s2, c), n in rows.items() if m2 == m and s2 == s and n} for s in ("user", "assistant")}
        n = {s: sum(x.values()) for s, x in side.items()}
        u, a = ({c: v / n[s] for c, v in side[s].items()} for s in ("user", "assistant"))
        js = sum((u.get(c, 0) * math.log(u[c] / ((u[c] + a.get(c, 0)) / 2)) if u.get(c) else 0) + (a.get(c, 0) * math.log(a[c] / ((a[c] + u.get(c, 0)) / 2)) if a.get(c) else 0) for c in u.keys() | a.keys()) / 2
        out[m] = -sum(x * math.log(x) for x in u.values()), math.sqrt(max(js, 0)) if min(n.values()) >= 10 else None
    return out


def contrasts(rows):
    k = measures(rows)
    mean = lambda i, months: (lambda v: sum(v) / len(v) if v else None)([k[m][i] for m in months if m in k and k[m][i] is not None])
    out = {}
    for name, (x, a, b) in catalog.CONTRASTS.items():
        p, q = mean(x != "entropy_user", a), mean(x != "entropy_user", b)
        out[name] = None if p is None or q is None else round(p - q, 9)
    return out


def test_grid_rows(spark):
    """Nine p-values a setting from the draws, by plain Python; settings are tested apart."""
    other = [(m, r, (c + len(m + r) + i) % 3) for i, (m, r, c) in enumerate(ROWS)]
    both = counts(spark, k=40, svd_dims=100).unionByName(counts(spark, other, k=60, svd_dims=100))
    got = {r["k"]: r for r in catalog.grid_tests(both, 12).collect()}
    drawn = {m: x.collect() for m, x in resample.null_tables(both, "month", "role", "cluster", 12, ("k", "svd_dims")).items()}
    for k, rows in ((40, ROWS), (60, other)):
        real = contrasts({(m, r, str(c)): n for (m, r, c), n in Counter(rows).items()})
        for name, (column, short) in catalog.GRID_NAMES.items():
            assert got[k][column] == pytest.approx(real[name], abs=2e-9)
            for model, label in catalog.GRID_MODELS.items():
                null = []
                for p in range(12):
                    v = contrasts({(r["month"], r["role"], r["cluster"]): r["n"] for r in drawn[model] if r["perm_id"] == p and r["k"] == k})[name]
                    null += [] if v is None else [v]
                hits = sum(v >= real[name] - 2e-9 if real[name] >= 0 else v <= real[name] + 2e-9 for v in null)
                assert got[k][f"p_{label}_{short}"] == pytest.approx(hits / len(null))
        assert got[k]["min_user_per_month"] == min(Counter(m for m, r, _ in rows if r == "user").values())
    assert set(got[40].asDict()) == {"k", "svd_dims", "min_user_per_month", "min_assistant_per_month", *(c for c, _ in catalog.GRID_NAMES.values()), *(f"p_{b}_{s}" for b in catalog.GRID_MODELS.values() for _, s in catalog.GRID_NAMES.values())}


def test_lloyd_is_a_plain_loop(spark):
    """Centres and costs of all settings and starts at once are those of one model after the other."""
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(size=(40, 6)) * 0.3 + c for c in r.normal(size=(5, 6)) * 3] + [np.zeros((2, 6))])
    rows = spark.createDataFrame([([float(v) for v in row],) for row in x], "vec array<double>").repartition(3)
    order = np.array([row["vec"] for row in rows.orderBy(lloyd.F.xxhash64("vec"), "vec").collect()])
    settings = [(4, 6), (5, 3), (2, 6)]
    got = lloyd.fit(rows, settings, starts=4, seed=9)
    for k, d in settings:
        best = None
        unit = lloyd.cut(order, d, True)
        for start in range(4):
            c = lloyd.spread_out(unit, k, np.random.default_rng([9, k, d, start]))
            for _ in range(lloyd.PASSES):
                far = ((unit[:, None] - c[None]) ** 2).sum(2)
                at, cost = far.argmin(1), far.min(1).sum()
                new = np.array([unit[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
                moved, c = ((new - c) ** 2).sum(), new
                if moved <= lloyd.TOLERANCE * unit.var(axis=0).mean():
                    break
            best = min(best, (cost, start, c), key=lambda b: b[:2]) if best else (cost, start, c)
        assert got[k, d][1] == pytest.approx(best[0], rel=1e-6) and np.allclose(got[k, d][0], best[2], atol=1e-6)
    assert lloyd.fit(rows.limit(0), [(3, 2)])[3, 2][0].shape == (0, 2)
    few = lloyd.fit(rows.limit(1), [(3, 6)], starts=2)[3, 6][0]
    assert few.shape == (3, 6)
