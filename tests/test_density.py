"""Density clustering against a sequential version that compares all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import density, numbering


def brute(ids, vectors, least, min_samples):
    """{id: set of ids of its cluster, or None}: sorted edges, one merge after the other, the tree walked from its root."""
    v = np.array(vectors, float)
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    n = len(v)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    edges = sorted((w[i, j], ids[i], ids[j]) for i in range(n) for j in range(n) if ids[i] < ids[j])
    tree = {i: i for i in ids}

    def root(x):
        while tree[x] != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    node = {i: ("leaf", i) for i in ids}
    size = {("leaf", i): 1 for i in ids}
    kids = {}
    for x, a, b in edges:
        p, q = root(a), root(b)
        if p != q:
            e = ("merge", x, a, b)
            kids[e] = (node[p], node[q])
            size[e] = size[node[p]] + size[node[q]]
            tree[q] = p
            node[p] = e
    top = node[root(ids[0])]

    def members(t):
        out, stack = set(), [t]
        while stack:
            t = stack.pop()
            if t[0] == "leaf":
                out.add(t[1])
            else:
                stack += kids[t]
        return out

    clusters, todo = [], [(top, None, 0.0)]
    while todo:
        t, parent, birth = todo.pop()
        me, mass, all_ = len(clusters), 0.0, members(t)
        clusters.append([parent, all_, 0.0])
        while True:
            dens = 1 / max(t[1], 1e-12)
            big = [k for k in kids[t] if size[k] >= least]
            mass += (dens - birth) * sum(size[k] for k in kids[t] if size[k] < least)
            if len(big) != 1:
                mass += (dens - birth) * sum(size[k] for k in big)
                todo += [(k, me, dens) for k in big]
                break
            t = big[0]
        clusters[me][2] = mass
    worth = [c[2] for c in clusters]
    keep = [False] * len(clusters)
    for i in range(len(clusters) - 1, 0, -1):
        under = sum(worth[j] for j, c in enumerate(clusters) if c[0] == i)
        keep[i] = under <= worth[i]
        worth[i] = max(worth[i], under)
    label = dict.fromkeys(ids)
    for i, c in enumerate(clusters):
        if keep[i]:
            for x in c[1]:
                if label[x] is None:
                    label[x] = frozenset(c[1])
    return label


def blobs(seed, sizes, noise, d=6, spread=0.12):
    r = np.random.default_rng(seed)
    at = [r.normal(size=d) for _ in sizes]
    v = np.vstack([c / np.linalg.norm(c) + spread * r.normal(size=(n, d)) for c, n in zip(at, sizes, strict=True)] + [r.normal(size=(noise, d))])
    return v[r.permutation(len(v))]


def frame(spark, v, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)] + list(extra), "vec_id long, embedding array<double>").repartition(3)


def as_sets(got):
    by = {}
    for r in got:
        by.setdefault(r["label"], set()).add(r["vec_id"])
    return {r["vec_id"]: None if r["label"] == density.NOISE else frozenset(by[r["label"]]) for r in got}


@pytest.mark.parametrize(("seed", "sizes", "noise", "least", "hot", "tree_rows"), [(1, [60, 50, 40], 50, 10, 0, 10**6), (2, [90, 30], 30, 8, 40, 0), (3, [], 120, 5, 0, 0), (4, [200, 100, 80, 60], 60, 12, 0, 10**6)])
def test_all_pairs_equal_the_sequential_version(spark, seed, sizes, noise, least, hot, tree_rows):
    v = blobs(seed, sizes, noise)
    v[:hot] = v[0]  # one vector many times
    odd = [(5000, None), (5001, []), (5002, [float("nan")] * 6), (5003, [None] * 6), (5004, [1.0]), (None, [1.0] * 6)]
    got = density.clustered(frame(spark, v, odd), "vec_id", "embedding", least=least, k=len(v), block_rows=1000, tree_rows=tree_rows).collect()
    want = brute(list(range(len(v))), v, least, least)
    assert as_sets(got) == want
    if sizes:
        assert len({s for s in want.values() if s}) > 1
    first = sorted((min(r["vec_id"] for r in got if r["label"] == k), k) for k in {r["label"] for r in got} - {-1})
    assert [k for _, k in first] == list(range(len(first)))


def test_chains_over_ranges(spark, monkeypatch):
    """The hierarchy is the same where running sums are cut into small stretches."""
    monkeypatch.setattr(numbering, "RANGE_ROWS", 15)
    monkeypatch.setattr(numbering.running, "__defaults__", (15,))
    v = blobs(7, [40, 30], 20)
    got = density.clustered(frame(spark, v), "vec_id", "embedding", least=8, k=len(v), block_rows=1000).collect()
    assert as_sets(got) == brute(list(range(len(v))), v, 8, 8)


def test_few_rows(spark):
    assert [r["label"] for r in density.clustered(frame(spark, [[1.0, 0.0]]), "vec_id", "embedding").collect()] == [-1]
    assert density.clustered(frame(spark, []), "vec_id", "embedding").collect() == []
    same = density.clustered(frame(spark, [[1.0, 0.0]] * 40), "vec_id", "embedding", least=5).collect()
    assert len(same) == 40 and len({r["label"] for r in same}) == 1


def test_recall_of_blocks(spark):
    v = blobs(9, [700, 500, 400], 400, d=16)
    reps = density.copies(density.points(frame(spark, v), "vec_id", "embedding")).select("id", "vec", "mult")
    found = density.neighbours(reps, 15, block_rows=256)
    assert density.recall(reps, found, 15, every=20) >= 0.9
    assert found.where(F.size("near") < 15).count() == 0


def test_entropy_without_noise_is_what_sql_says_of_the_labels(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from threadloom.plans import more

    v = blobs(1, [60, 50, 40], 50)
    labels = density.clustered(frame(spark, v), "vec_id", "embedding", least=10)
    labels.write.parquet(f"{tmp_path}/labels")
    got = more.noise_free_entropy(spark.read.parquet(f"{tmp_path}/labels").withColumn("period", F.col("vec_id") % 4)).collect()
    want = duckdb.sql(f"""WITH l AS (SELECT vec_id % 4 AS p, label FROM '{tmp_path}/labels/*.parquet'), c AS (SELECT p, label, count(*) AS n FROM l WHERE label <> -1 GROUP BY 1, 2),
      e AS (SELECT p, count(*) AS k, sum(-q * ln(q)) AS h FROM (SELECT p, n / sum(n) OVER (PARTITION BY p) AS q FROM c) GROUP BY p)
      SELECT p, count(*), coalesce(any_value(k), 0), round(coalesce(any_value(h), 0), 6) FROM l LEFT JOIN e USING (p) GROUP BY p""").fetchall()
    assert sorted((r["period"], r["n"], r["clusters"], r["entropy"]) for r in got) == sorted(want) and max(w[3] for w in want) > 0
