"""The pipeline's stages, one after the other, against plain Python."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute  # noqa: E402
from threadloom.llm import pipeline as cp  # noqa: E402


def _words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


PASSAGE, LEAK = _words("pass", 20), _words("leak", 15)
DOCS = {
    1: _words("a", 40),
    2: _words("a", 40),  # a copy
    3: _words("b", 30) + " " + PASSAGE,
    4: _words("c", 30) + " " + PASSAGE + " " + _words("d", 5),  # loses the passage
    5: PASSAGE,  # nothing else than the passage of 3
    6: _words("e", 20) + " " + LEAK,  # contaminated
    7: "",
    8: _words("f", 2500),  # more than one piece
    9: "rejected " * 30,
}


def _write(spark, path):
    rows = [(d, t, "en", "web", len(t)) for d, t in DOCS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("x", LEAK), ("y", _words("other", 12))], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, tmp_path, monkeypatch):
    """What each stage leaves is what plain Python says of what the one before left."""
    sf = _write(spark, f"file://{tmp_path}/t")
    seen = {}
    monkeypatch.setattr(cp.quality, "document_stats", lambda docs: docs.select("doc_id", "text"))
    monkeypatch.setattr(cp.quality, "fit", lambda stats, labels: None)
    monkeypatch.setattr(cp.quality, "score", lambda stats, model: stats.selectExpr("doc_id", "cast(coalesce(text, '') not like 'rejected%' as int) as predicted"))

    def watched(name, stage):
        def run(s, docs, d):
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            return stage(s, docs, d)

        return run

    monkeypatch.setattr(cp, "STAGES", [(n, watched(n, st)) for n, st in cp.STAGES])
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    packed = cp.run(spark, sf).collect()
    assert list(seen) == ["quality", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    assert seen["quality"] == DOCS
    assert seen["near_duplicates"] == {d: t for d, t in DOCS.items() if d != 9}
    classes = brute.classes(list(seen["near_duplicates"].items()))
    assert seen["substring_dedup"] == {d: t for d, t in seen["near_duplicates"].items() if classes[d][1] == d}
    assert 2 not in seen["substring_dedup"] and {1, 3, 4, 5, 6, 7, 8} <= seen["substring_dedup"].keys()
    cut = brute.substring(list(seen["substring_dedup"].items()))
    assert seen["decontamination"].keys() == {d for d, (n, gone, _) in cut.items() if not gone or gone < n}
    assert 5 not in seen["decontamination"]
    assert seen["decontamination"][4] == _words("c", 30) + " " + _words("d", 5)
    assert all(seen["decontamination"][d] == DOCS[d] for d in seen["decontamination"] if d != 4)
    found = brute.contamination(list(seen["decontamination"].items()), [("x", LEAK), ("y", _words("other", 12))])
    assert seen["packing"] == {d: t for d, t in seen["decontamination"].items() if not found[d][4]}
    assert seen["packing"].keys() == {1, 3, 4, 7, 8}
    t = Tokenizer.from_file(path)
    size = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in seen["packing"].items()}
    assert {d: sum(r["length"] for r in packed if r["doc_id"] == d) for d in size} == size
    assert {r["doc_id"] for r in packed} == size.keys() and size[8] > 2048


def test_quality_rejects(spark, tmp_path):
    """The first stage drops exactly what the classifier rejects, and keeps rows and columns."""
    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no tables here")
    docs = cp.table(spark, sf, "documents")
    stats = cp.quality.document_stats(docs)
    model = cp.quality.fit(stats, cp.table(spark, sf, "labels").where(cp.fold(cp.F.col("doc_id"), 3) != 1))
    bad = {r["doc_id"] for r in cp.quality.score(stats, model).collect() if r["predicted"] == 0}
    kept = cp.quality_stage(spark, docs, sf)
    assert bad and kept.columns == cp.COLUMNS
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.select(*cp.COLUMNS).collect() if r["doc_id"] not in bad)


ITEM = [("x", LEAK), ("y", _words("other", 12))]
ODD = [
    (None, _words("clean", 30)),  # without an id, clean: stays
    (None, _words("g", 5) + " " + LEAK + " end"),  # without an id, contaminated: goes
    (2, _words("h", 30)),  # of two rows of one id the clean one stays
    (2, _words("i", 25) + " " + _words("other", 12)),
    (1, _words("j", 40)),  # identical rows leave one
    (1, _words("j", 40)),
    (1, _words("j", 40)),
    (3, _words("k", 40)),  # of a class the least id stays, though it is there twice
    (3, "another text of the id " + _words("l", 30)),
    (7, _words("k", 40) + " more"),
    (None, _words("k", 40)),
    (8, "rejected " * 20),  # of one id a rejected and a good text
    (8, _words("m", 30)),
    (9, None),
    (9, ""),
    (None, None),
    (10, _words("n", 10_000)),
    (11, _words("o", 30)),
]


def _odd_brute():
    """Rows that are left before packing, stage by stage."""
    rows = [(d, t, k) for k, (d, t) in enumerate(ODD) if not (t or "").startswith("rejected")]
    classes = brute.classes([(k, t) for _, t, k in rows])
    least = {}
    for d, t, k in rows:
        c = classes[k][1]
        least[c] = min(least.get(c, (True, 0, "", k)), (d is None, d or 0, cp_md5(t), k))
    rows = [r for r in rows if least[classes[r[2]][1]][3] == r[2]]
    found = brute.contamination([(k, t) for _, t, k in rows], ITEM)
    return sorted(((d, t or "") for d, t, k in rows if not found[k][4]), key=str)


def cp_md5(text):
    import hashlib

    return hashlib.md5((text or "").encode()).hexdigest()


def test_odd_rows_end_to_end(spark, tmp_path, monkeypatch):
    """Rows without ids, with shared ids and identical rows are judged one by one."""
    sf = f"file://{tmp_path}/odd"
    rows = [(d, t, "en", "web", 1, "x") for d, t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(ITEM, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (8, 0), (99, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(cp.quality, "document_stats", lambda docs: docs.select("doc_id", "text"))
    monkeypatch.setattr(cp.quality, "fit", lambda stats, labels: None)
    monkeypatch.setattr(cp.quality, "score", lambda stats, model: stats.selectExpr("doc_id", "cast(coalesce(text, '') not like 'rejected%' as int) as predicted"))
    seen = []
    pack = dict(cp.STAGES)["packing"]
    monkeypatch.setattr(cp, "STAGES", [*cp.STAGES[:-1], ("packing", lambda s, docs, d: (seen.extend((r["doc_id"], r["text"] or "") for r in docs.collect()), pack(s, docs, d))[1])])
    pytest.importorskip("public_tokenizers")
    packed = cp.run(spark, sf).collect()
    want = _odd_brute()
    assert sorted(seen, key=str) == want
    assert (2, _words("h", 30)) in want and all(LEAK not in t and "other11" not in t for _, t in want) and [d for d, t in want if t == _words("j", 40)] == [1] and [d for d, t in want if t.startswith("k0 ")] == [3]
    assert {r["doc_id"] for r in packed} == {d for d, _ in want}


def test_rows_told(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (5, "d"), (None, None)], "doc_id long, text string").selectExpr("*", "'e' lang", "'s' source", "1L n_chars")
    rows, odd = cp.rows_told(docs, spark.createDataFrame([(40,)], "doc_id long"))
    got = {(r["doc_id"], r["text"]): r["_row"] for r in rows.collect()}
    assert got[5, "d"] == 5 and sorted(v for k, v in got.items() if k != (5, "d")) == [41, 42, 43, 44]
    assert {(r["_row"], r["doc_id"]) for r in odd.collect()} == {(v, k[0]) for k, v in got.items() if k != (5, "d")}
    assert cp.rows_told(docs.where("doc_id = 5"))[1] is None
    top = spark.createDataFrame([((1 << 63) - 1, "a"), (-4, "b"), (-4, "b")], "doc_id long, text string").selectExpr("*", "'e' lang", "'s' source", "1L n_chars")
    assert sorted(r["_row"] for r in cp.rows_told(top)[0].collect()) == [-6, -5, (1 << 63) - 1]


def test_labels_of_shared_ids(spark, monkeypatch):
    """A label of an id counts for every row that has it, and for no row that has a number of its own by chance."""
    seen = {}
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, text string").selectExpr("*", "'e' lang", "'s' source", "1L n_chars")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    monkeypatch.setattr(cp, "table", lambda s, d, n: labels)
    monkeypatch.setattr(cp, "fold", lambda c, mod: F.lit(0))
    monkeypatch.setattr(cp.quality, "document_stats", lambda d: d)
    monkeypatch.setattr(cp.quality, "fit", lambda stats, known: seen.update({t["text"]: k["quality"] for k in known.collect() for t in stats.collect() if t["doc_id"] == k["doc_id"]}))
    monkeypatch.setattr(cp.quality, "score", lambda stats, model: stats.selectExpr("doc_id", "1 as predicted"))
    assert cp.quality_stage(spark, docs, "").count() == 4
    assert seen == {"a": 1, "b": 1, "c": 0}
