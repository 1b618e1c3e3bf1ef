"""The reduced space within bounds: what a batch needs beside its basis, columns and stretches one after the other, and packed rows."""

import tracemalloc

import numpy as np
import pytest

from threadloom.operators import svd, topics
from threadloom.plans import catalog


def test_a_batch_gathers_no_more_than_a_row_needs():
    r = np.random.default_rng(2)
    basis, rows, each = r.random((3_000, 60)), 400, 500
    off, idx, val = np.arange(0, rows * each + 1, each), np.concatenate([r.permutation(3_000)[:each] for _ in range(rows)]), r.random(rows * each)
    tracemalloc.start()
    got = svd._times(off, idx, val, basis)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * idx.size * basis.shape[1] / 20
    for i in (0, 17, 399):
        assert got[i] == pytest.approx(val[i * each : (i + 1) * each] @ basis[idx[i * each : (i + 1) * each]])


def test_columns_and_stretches_make_the_same_space(spark, monkeypatch):
    monkeypatch.setattr(svd, "COLUMN_BYTES", 8 * 25 * 4)
    monkeypatch.setattr(svd, "CHUNK", 7)
    monkeypatch.setattr(svd, "TALL", 10)
    monkeypatch.setattr(svd, "GATHERED", 3)
    rng = np.random.default_rng(4)
    dense = rng.random((60, 3)) @ rng.random((3, 25)) + 0.01 * rng.random((60, 25))
    dense[rng.random(dense.shape) < 0.4] = 0
    rows = spark.createDataFrame([(d, [t for t in range(25) if dense[d, t]], [float(x) for x in dense[d] if x]) for d in range(60)], "id int, idx array<int>, val array<double>").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    v, s = svd.decompose(rows, 25, 4, more=15, passes=8)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    _, want, basis = np.linalg.svd(dense, full_matrices=False)
    assert s == pytest.approx(want[:4], rel=1e-6)
    assert np.abs(np.sum(v * basis[:4].T, axis=0)) == pytest.approx(np.ones(4), abs=1e-5)


def test_packed_rows_have_the_long_forms_weights_and_stay_apart(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa aa"), (None, "bb"), (3, None), (4, "zz")], "id int, text string").repartition(2)
    rows, terms = topics.tfidf_rows(docs, "id", "text", [], min_df=1, max_df=1.0)
    name = {r["i"]: r["term"] for r in terms.collect()}
    assert list(name.values()) == sorted(name.values())
    got = sorted((r["id"] or 0, name[i], round(x, 12)) for r in rows.collect() for i, x in zip(r["idx"], r["val"], strict=True))
    assert got == sorted((r["id"] or 0, r["term"], round(r["weight"], 12)) for r in topics.tfidf(docs, "id", "text", [], min_df=1, max_df=1.0).collect())
    assert sorted(r["id"] or 0 for r in rows.collect()) == [0, 1, 1, 4]


def test_clusters_of_texts_have_a_row_a_document(spark):
    docs = spark.createDataFrame([(i // 2, ("red blue green " if i % 2 else "dog cat bird ") * 3) for i in range(24)] + [(99, None)], "id int, text string")
    models, reduced = svd.fit_texts(docs, "id", "text", [], [(2, 2)])
    got = [(r["id"], r["cluster"]) for r in models[2, 2].assign(reduced, "id").collect()]
    assert sorted(i for i, _ in got) == sorted(i // 2 for i in range(24)) and len({c for _, c in got}) == 2
    empty = svd.fit_texts(docs.limit(0), "id", "text", [], [(2, 2)])
    assert empty[0][2, 2].assign(empty[1], "id").collect() == []


def test_grid_counts_each_message_once(spark, tmp_path, monkeypatch):
    """Messages that share an id, as conversations that are there twice, count as two and not as four."""
    monkeypatch.setattr(catalog, "GRID", ((3,), (2,)))
    monkeypatch.setattr(catalog, "GRID_MONTH_ROWS", 5)
    monkeypatch.setattr(catalog, "DRAWS", 3)
    words = ["red blue", "dog cat", "sun rain", "tree leaf"]
    rows = [(i, t, ("user", "assistant")[t % 2], f"{words[(i + t) % 4]} {words[(i * i) % 4]}") for i in range(96) for t in range(2)]
    spark.createDataFrame(rows + rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (got,) = catalog.QUERIES["robustness_grid"](spark, str(tmp_path)).collect()
    assert (got["min_user_per_month"], got["min_assistant_per_month"]) == (24, 24)
