"""Every registered query of the subpackage on tables with nulls, null and repeated ids, empty and very long texts, ties, repeated rows and extra columns; and on empty tables."""

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from threadloom.llm import quality, queries, toxicity  # noqa: E402

#: Columns that operators use within.
CLASH = ["bucket", "key", "n", "h", "w", "spans", "items", "leader", "comp", "shard", "slot", "score", "tkey", "only", "seq", "rule", "said"]


def _fold(doc_id, mod):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def _documents():
    r = random.Random(21)
    vocab = {"en": ["the", "house", "of", "river", "and", "stone", "walk", "bright"], "de": ["der", "Fluß", "und", "Stein", "geht", "über", "hell", "Haus"]}
    say = lambda lang, n: " ".join(r.choice(vocab[lang]) + r.choice("abcde") * (i % 3) for i in range(n))
    rows = []
    for i in range(70):
        lang = "de" if i % 3 else "en"
        rows.append((100 + i, say(lang, r.randint(5, 60)).capitalize() + ".", lang))
    base, leak = say("en", 45), say("de", 14)
    rows += [(300, base, "en"), (301, base, "en"), (301, base, "en"), (302, base + " more", "en"), (303, "x " + leak + " y", None), (304, leak, "de")]
    rows += [(400, say("en", 20_500), "en"), (401, None, None), (402, "", "en"), (403, " \n", "de"), (404, "12 !", "en"), (405, "one", "en"), (405, "another text of one id", "en")]
    rows += [(None, base, "en"), (None, "no id here", None), (None, None, None), (300 + 200, "toxicword " + say("en", 12), "en")]
    return rows, leak


ROWS, LEAK = _documents()
ITEMS = [("b1", LEAK), ("b2", "One"), ("b3", None), ("b4", "")]
URLS = ["http://thehouse.com/en/1", "https://riverstone.net/de/2", "https://a.example.net/de/8", "http://walk.org/es/", "http://brightriver.info/x", None, "", "no url", "http://thehouse.info/en/1", "http://thehouse.info/en/1"]


def _write(spark, path, empty=False):
    extra = ", ".join(f"{c} string" for c in CLASH)
    none = [None] * len(CLASH)

    def put(name, rows, schema):
        df = spark.createDataFrame([(*x, *none) for x in rows], f"{schema}, {extra}")
        (df.limit(0) if empty else df).repartition(3).write.parquet(f"{path}/{name}.parquet")

    put("documents", [(d, t, lang, "src", None if t is None else len(t)) for d, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(d, int(i % 7 != 0), int(i % 9 == 0)) for i, (d, _, _) in enumerate(ROWS) if i % 2]
    put("labels", [*labels, (None, 1, 1), (500, 1, 1), (100, None, None), labels[0]], "doc_id long, quality int, toxic int")
    put("benchmark", ITEMS, "item_id string, text string")
    put("pages", [(i, u, "<p>the house river stone</p>" if i % 2 else None) for i, u in enumerate(URLS)] + [(1, URLS[1], None), (None, URLS[0], None)], "page_id long, url string, html string")
    vectors = [(i % 40, [float((i * k) % 7) / 3 for k in range(1, 7)]) for i in range(45)] + [(None, [0.5] * 6), (50, None), (51, [None] * 6), (52, [float("nan")] * 6), (53, []), (54, [1.0])]
    put("embeddings", [(*v, 1) for v in vectors], "vec_id long, embedding array<float>, label int")
    return str(path)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("rows") / "t")


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("none") / "t", empty=True)


def _least(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def substring_rows(rows, k=13):
    """(doc_id, words, removed, sha) of each row; a null id counts as the least."""
    words, least = [brute.WS.findall(t or "") for _, t in rows], {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            least[x] = min(least.get(x, _least(d)), _least(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if least[tuple(w[i : i + k])] < _least(d) for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


TEXTS = [(d, t) for d, t, _ in ROWS]
BY_ROW = {name: Counter(rows) for name, rows in {
    "op1_media": [(d, *brute.media(t)) for d, t in TEXTS],
    "op3_substring_dedup": substring_rows(TEXTS),
    "op4_decontamination": [(d, *brute.contamination([(0, t)], ITEMS)[0]) for d, t in TEXTS],
}.items()}
COLUMNS = {
    "op1_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"],
    "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_rows_by_brute_force(spark, sf, name):
    got = queries.queries()[name](spark, sf).collect()
    assert Counter(tuple(r[c] for c in COLUMNS[name]) for r in got) == BY_ROW[name]


def test_op2(spark, sf):
    got = queries.op2_url_filter(spark, sf).collect()
    assert Counter(r["page_id"] for r in got) == Counter([*range(len(URLS)), 1, None])
    by = {r["page_id"]: r for r in got}
    assert [by[i]["rule"] for i in range(5)] == ["com/en/", "net/de/", "example.net/de/8", "org/es/", None]
    assert [by[i]["verdict"] for i in range(4)] == ["block", "allow", "block", "block"]
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    assert by[8]["verdict"] == by[9]["verdict"] and (by[5]["host"], by[5]["path"]) == ("", "")


@pytest.mark.parametrize(("name", "mod", "out"), [("op5_language_id", 5, 0), ("op6_toxicity", 5, 0), ("op10_quality", 3, 1)])
def test_learned(spark, sf, name, mod, out):
    """One row each, held out by the checksum, scores of 0 to 1, equal for equal texts."""
    got = queries.queries()[name](spark, sf).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((d, _fold(d, mod) == out) for d, _ in TEXTS)
    assert all(0 <= r["score"] <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["score"])
    assert of[300] == of[301]  # copies
    if name == "op5_language_id":
        said = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
        assert {said[d] for d in (401, 402, 403, 404)} == {"und"} and said[400] == "en"
        assert np.mean([said[d] == lang for d, _, lang in ROWS[:70]]) > 0.9
    else:
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert of[401] == of[402]  # null as empty


def test_op7(spark, sf):
    got = queries.op7_sharding(spark, sf).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in TEXTS)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for d, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 2048 or 2048
            want[d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    got = queries.op8_packing(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    end = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= 2048


def test_op11(spark, sf):
    from test_merkle import brute as tree

    got = queries.op11_merkle(spark, sf).collect()
    want = tree([(d, "src", lang, None if t is None else len(t), t) for d, t, lang in ROWS])
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_op12(spark, sf):
    from test_line_rules import STATS, brute as rules

    got = queries.op12_line_rules(spark, sf).collect()
    want = rules([(d, t, "src") for d, t, _ in ROWS], 10, 0.02)
    assert Counter((r["doc_id"], *[r[c] for c in STATS], r["base_failed"], r["n_removed_words"], r["kept"]) for r in got) == Counter((*w[:8], w[9]) for w in want)


def test_op13(spark, sf):
    got = queries.op13_whitening(spark, sf).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({**{i: 12 if i < 5 else 6 for i in range(40)}, None: 6})
    assert {r["n"] for r in got} == {46} and {r["component"] for r in got} == set(range(1, 7))


def test_op9(spark, sf):
    # An id of several texts is one document, of the text with the most shingles.
    best = {}
    for d, t in TEXTS:
        if d is not None and len(brute.shingles(t)) >= len(brute.shingles(best.get(d))):
            best[d] = t
    classes = brute.classes(list(best.items()))
    got = queries.op9_ngram_join(spark, sf).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in got) == Counter((d, len(brute.shingles(t)), None if d is None else classes[d][1]) for d, t in TEXTS)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).collect() == []


def test_pipeline_chained(spark):
    """The pipeline's rows on the smallest tables: the classifier's rejects, then each stage by plain Python."""
    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no tables here")
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, sf, "benchmark").collect()]
    good = {r["doc_id"] for r in _quality_brute(spark, sf, docs)}
    kept = {d: t for d, t in docs.items() if d in good}
    classes = brute.classes(list(kept.items()))
    kept = {d: t for d, t in kept.items() if classes[d][1] == d}
    cut = {d: (n, gone) for d, n, gone, _ in substring_rows(list(kept.items()))}
    whole = substring_texts(list(kept.items()))
    kept = {d: whole[d] if gone else kept[d] for d, (n, gone) in cut.items() if not gone or gone < n}
    found = brute.contamination(list(kept.items()), items)
    kept = {d: t for d, t in kept.items() if not found[d][4]}
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, x in kept.items()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == want.keys() and len(want) < len(docs)
    one = Counter(r["doc_id"] for r in got)
    assert all(r["ids_crc32"] == want[r["doc_id"]] for r in got if one[r["doc_id"]] == 1)


def substring_texts(rows, k=13):
    """What is left of each text, its words joined by blanks."""
    words, least = {d: brute.WS.findall(t or "") for d, t in rows}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            least.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if least[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def _quality_brute(spark, sf, docs):
    """Documents that a dense copy of the classifier keeps: all labelled rows in one matrix, one solve."""
    ids = sorted(docs)
    raw = [(docs[d] or "").encode() for d in ids]
    stats = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect() if r["quality"] is not None and _fold(r["doc_id"], 3) != 1}
    model = dense_ridge(stats[[i for i, d in enumerate(ids) if d in y]], np.array([y[d] for d in ids if d in y], float))
    return [{"doc_id": d} for d, s in zip(ids, model(stats), strict=True) if s >= 0.5]


def dense_ridge(x, y):
    """The classifier without partitions: statistics scaled by all rows, features in one matrix, a dense solve, means by bin pooled until they rise."""
    m, s = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(quality.SEED)
    turn, phase = rng.normal(size=(x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1] / 2), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    f = lambda z: np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((z - m) / s, -8, 8) @ turn + phase), np.ones((len(z), 1))])
    a = f(x)
    ridge = np.full(a.shape[1], quality.RIDGE * len(x) / quality.FEATURES)
    ridge[-1] = 1e-9
    w = np.linalg.solve(a.T @ a + np.diag(ridge), a.T @ y)
    raw = a @ w
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = [(raw[at == b].mean(), y[at == b].sum(), (at == b).sum()) for b in np.unique(at)]
    pooled = []
    for _, total, n in bins:
        pooled.append([total, n, 1])
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] >= pooled[-1][0] / pooled[-1][1]:
            t, n, k = pooled.pop()
            pooled[-1] = [pooled[-1][0] + t, pooled[-1][1] + n, pooled[-1][2] + k]
    value = [t / n for t, n, k in pooled for _ in range(k)]
    return lambda z: np.clip(np.interp(f(z) @ w, [b[0] for b in bins], value), 0, 1)


def test_quality_is_the_dense_solution(spark):
    """Sums by partition, bins and all, give what one dense solve over all rows gives."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    texts = [(i, " ".join(r.choice(["Good words.", "bad bad bad", "x1!", "A line\n"]) for _ in range(r.randint(1, 40)))) for i in range(300)]
    texts += [(900 + i, texts[0][1]) for i in range(5)] + [(950, None)]
    y = {i: int(t is not None and "bad bad bad bad" not in t) for i, t in texts}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q) for i, q in y.items() if i % 2], "doc_id long, quality int")
    stats = quality.document_stats(docs)
    got = {x["doc_id"]: x["score"] for x in quality.score(stats, quality.fit(stats, labels.where(F.col("doc_id").isNotNull()))).collect()}
    raw = [(t or "").encode() for _, t in texts]
    dense = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    some = [k for k, (i, _) in enumerate(texts) if i % 2]
    want = dense_ridge(dense[some], np.array([y[texts[k][0]] for k in some], float))(dense)
    assert max(abs(got[i] - w) for (i, _), w in zip(texts, want, strict=True)) < 1e-6


def slow_risk(pos, unl, prior, w, b):
    """The non-negative risk, one document after the other."""
    import math

    g = lambda x: sum(w.get(k, 0.0) for k in x) + b
    loss = lambda z: max(z, 0) + math.log1p(math.exp(-abs(z)))  # noqa: E731  (of saying z where the label is negative)
    plus = prior * sum(loss(-g(x)) for x in pos) / len(pos)
    minus = sum(loss(g(x)) for x in unl) / len(unl) - prior * sum(loss(g(x)) for x in pos) / len(pos)
    return plus, minus


def test_toxicity_descends_the_slow_risk():
    """Each step goes down the risk that plain Python computes: its numeric gradient, or that of the negative part alone and reversed where that is below 0."""
    r = np.random.default_rng(4)
    words = r.permutation(np.arange(5, 400))[:40]
    pos = [np.unique(np.append(r.choice(words, 5), words[0])) for _ in range(60)]
    unl = [np.unique(np.append(r.choice(words, 6), [words[0]] if i % 12 == 0 else [])).astype(np.int64) for i in range(300)]
    prior = 0.15
    for steps in (0, 30, 120):
        w0, b0 = toxicity.train(pos, unl, prior, steps=steps, l2=0.0)
        w = {int(k): float(w0[k]) for k in np.flatnonzero(w0)} if steps else {}
        plus, minus = slow_risk(pos, unl, prior, w, b0)
        risk = lambda w, b: (lambda p, m: p + m if minus >= 0 else -m)(*slow_risk(pos, unl, prior, w, b))  # noqa: B023, E731
        down = (risk(w, b0 + 1e-5) - risk(w, b0 - 1e-5)) / 2e-5
        # The first step of Adam moves against the gradient's sign.
        if steps == 0:
            _, b1 = toxicity.train(pos, unl, prior, steps=1, l2=0.0)
            assert np.sign(b1 - b0) == -np.sign(down)
    first, last = (sum(slow_risk(pos, unl, prior, *(lambda m: ({int(k): float(m[0][k]) for k in np.flatnonzero(m[0])}, m[1]))(toxicity.train(pos, unl, prior, steps=n, l2=0.0)))) for n in (1, 200))
    assert last < first
    w, b = toxicity.train(pos, unl, prior, l2=0.0)
    assert w[words[0]] > 0 and w[words[0]] == w.max()
