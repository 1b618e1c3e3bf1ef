"""The learned operators: exact code lengths, held-out accuracy, degenerate inputs."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import langid, quality, toxicity, urlfilter
from threadloom.llm.queries import fold


def slow_bits(train, text):
    """PPM, method C with exclusion, order 3, one symbol after the other."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in train:
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[b[i - k : i]][b[i]] += 1
    b = b"\n\n\n" + text.encode()
    total = 0.0
    for i in range(3, len(b)):
        out = set()
        for k in (3, 2, 1, 0):
            c = {s: n for s, n in counts.get(b[i - k : i], {}).items() if s not in out}
            if not c:
                continue
            den = sum(c.values()) + len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / den)
                break
            total -= math.log2(len(c) / den)
            out |= set(c)
        else:
            total += math.log2(256 - len(out))
    return total


def test_code_lengths(spark):
    train = {"x": ["the cat sat on the mat", "that hat", "\n\nthe"], "y": ["der hund", "und der hut ist gut", "é"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    model = langid.fit(spark.createDataFrame([*rows, (90, None, "x"), (91, "z", None)], "doc_id long, text string, lang string"))
    texts = ["the hat", "und der", "q", "ÿ~", "", "that hund, der cat\n", "\n", "aa", "a"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for scorer in (langid.Scorer(model), langid.Scorer(model)):
        got = scorer.bits(np.frombuffer(data, np.uint8), offs)
        for t, row in zip(texts, got, strict=True):
            for lang, bits in zip(model.langs, row, strict=True):
                assert abs(bits - slow_bits(train[lang], t)) < 1e-6, (t, lang)
        scorer.dense = None  # the way of a large number of pairs


def test_distribution_sums_to_one():
    g, n = np.unique(langid.grams(np.frombuffer(b"abracadabra", np.uint8), np.array([0, 11]))[0], return_counts=True)
    m = langid.Model(["x"], g, n[:, None].astype(float))
    for ctx in (0x0A0A0A, 0x616272, 0x7A7A61, 0x7A7A7A):
        all_ = (np.uint32(ctx) << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        assert abs(np.exp2(-m.code_lengths(all_)[:, 0]).sum() - 1) < 1e-9


def test_language_rows(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 1), (2, "der hund", "de", 1), (3, None, "en", 1), (4, "12 !", None, 1), (5, "", "de", 1), (1, "the cat", "en", 1)], "doc_id long, text string, lang string, letters int")
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in langid.predict(docs, langid.fit(docs)).collect())
    assert [g[:2] for g in got] == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert langid.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_all_training_text_counts(spark, monkeypatch):
    """Few long documents beside many short ones: each language is learnt, from all of its text."""
    monkeypatch.setattr(langid, "SLICE", 50_000)
    monkeypatch.setattr(langid, "HELD", 40)
    r = random.Random(4)
    say = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    rows = [(i, say("abc é", 3_000_000), "x") for i in range(3)] + [(10, say("def ", 5_000_000), "y")] + [(20 + i, say("gh i", 500), "y") for i in range(100)] + [(200, "q", "z")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.langs == ["x", "y", "z"]
    want = defaultdict(int)
    for _, t, lang in rows:
        b = t.encode()
        g, n = np.unique(langid.grams(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0], return_counts=True)
        for k, c in zip(g.tolist(), n.tolist(), strict=True):
            want[k, lang] += c
    level = model.level[0]
    assert {(k, lang): n for k, row in zip(level["keys"].tolist(), level["n"].tolist(), strict=True) for lang, n in zip(model.langs, row, strict=True) if n} == want


def _bad_and_good(n=600):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(10, 80))]
        toxic, junk = i % 6 == 0, i % 5 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["zzbad", "yyfoul", "xxvile"])
        text = " ".join(w).capitalize() + "."
        if junk:
            text = " ".join(w[:3] * 30)
        if toxic and junk:
            text += " zzbad"
        rows.append((i, text, int(not junk), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = _bad_and_good()
    docs = spark.createDataFrame([(i, t, 1) for i, t, *_ in rows] + [(9000, None, 1), (9001, "", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, x, 1) for i, _, _, x in rows if i % 2] + [(i, x, 1) for i, _, _, x in rows if i % 2 == 0] + [(3, None, 1)], "doc_id long, toxic int, text int")
    keep = fold(F.col("doc_id"), 5) != 0
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs.where(keep), labels.where(keep))).collect()}
    assert len(got) == len(rows) + 2
    assert np.mean([got[i]["predicted"] == x for i, _, _, x in rows]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.5
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {r["predicted"] for r in none} == {0}


def test_negative_part_is_corrected():
    """With unlabelled text that is all positive, plain risk would push the positives' words down; the corrected one doesn't."""
    pos = [np.array([5, 9])] * 60
    w, b = toxicity.train(pos, [np.array([5, 9])] * 30 + [np.array([7])] * 170, 0.15)
    s = lambda x: 1 / (1 + np.exp(-(w[x].sum() + b)))
    assert s([5, 9]) > 0.5 > s([7])


def test_quality(spark):
    rows = _bad_and_good()
    docs = spark.createDataFrame([(i, t, 1) for i, t, *_ in rows] + [(9000, None, 1), (9001, "", 1)], "doc_id long, text string, upper int")
    labels = spark.createDataFrame([(i, q, 1) for i, _, q, _ in rows] + [(5, None, 1)], "doc_id long, quality int, y int")
    stats = quality.document_stats(docs)
    got = {r["doc_id"]: r for r in quality.score(stats, quality.fit(stats, labels.where(fold(F.col("doc_id"), 3) != 1))).collect()}
    assert np.mean([got[i]["predicted"] == q for i, _, q, _ in rows]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] and 0 <= got[9000]["score"] <= 1
    assert {r["score"] for r in quality.score(stats, quality.fit(stats, labels.limit(0))).collect()} == {0.5}
    assert quality.score(quality.document_stats(docs.limit(0)), None).collect() == []


def test_statistics_and_isotonic():
    texts = ["Aa bb. Aa bb.", "", "x x x\nx x x\ny"]
    data, offs = "".join(texts).encode(), np.cumsum([0, *map(len, texts)])
    got = dict(zip(quality.STATS, quality.statistics(np.frombuffer(data, np.uint8), offs).T, strict=True))
    assert got["distinct_words"].tolist() == [0.5, 0, 2 / 7] and got["top_word"].tolist() == [0.5, 0, 6 / 7]
    assert got["repeated_lines"].round(6).tolist() == [0, 0, round(1 / 3, 6)] and got["capital_words"].tolist() == [0.5, 0, 0]
    assert got["same_as_last"].tolist() == [0, 0, 5 / 7] and got["distinct_pairs"].round(6).tolist() == [round(2 / 3, 6), 0, round(2 / 6, 6)]
    assert quality.isotonic(np.array([1.0, 0, 2, 4]), np.array([2.0, 2, 4, 4])).tolist() == [0.25, 0.25, 0.5, 1.0]


def test_rules_and_segments(spark):
    urls = [
        "http://a.b.COM/en/1?x", "https://example.com/en/7a", "https://Example.com/en/8", "http://x.net/de/1", "http://w.example.net/de/8", "http://example.net/de/9", "http://o.org/es/", "http://noexample.com/en/7",
        "http://q.org/fr/1", None, "nothing", "http://only.host", "http://h.org#/es/", "a://b://c/d", "http://HÉ.org/P?q", "",
    ]
    rows = [(i, u, "<p>spam farm the cat <b>spam</b> farm</p>", "h") for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(got) == len(urls)
    say = [(r["host"], r["path"], r["rule"]) for _, r in sorted(got.items())]
    assert say == [
        ("a.b.com", "/en/1", "com/en/"), ("example.com", "/en/7a", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("x.net", "/de/1", "net/de/"), ("w.example.net", "/de/8", "example.net/de/8"),
        ("example.net", "/de/9", "net/de/"), ("o.org", "/es/", "org/es/"), ("noexample.com", "/en/7", "com/en/"), ("q.org", "/fr/1", None), ("", "", None), ("", "", None), ("only.host", "", None), ("h.org", "", None), ("b:", "//c/d", None), ("hÉ.org", "/P", None), ("", "", None),
    ]
    want = ["block", "allow", "block", "allow", "block", "allow", "block", "block"]
    assert [got[i]["verdict"] for i in range(8)] == want and {got[i]["verdict"] for i in range(8, 16)} <= {"allow", "block"}
    costs = {"spam": 1.0, "farm": 1.0, "a": 0.5, "sp": 3.0}
    assert urlfilter.segment("spamfarm", costs, 9.0) == ["spam", "farm"]

    def cost(split):
        return sum(costs[w] if w in costs else 9.0 + 4 * len(w) for w in split)

    def splits(s):
        return [[]] if not s else [[s[:k], *r] for k in range(1, len(s) + 1) for r in splits(s[k:])]

    for word in ("spamafarm", "xspam", "aaa", "farmsp", "zz"):
        assert abs(cost(urlfilter.segment(word, costs, 9.0)) - min(map(cost, splits(word)))) < 1e-9
    assert urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string").limit(0)).collect() == []


def test_url_words_and_tokens_without_bounds(spark, monkeypatch):
    """Rare and long words split hosts, and long path tokens with one beginning stay apart."""
    r = random.Random(6)
    rare = ["".join(r.choice("bcdfg") for _ in range(7)) for _ in range(21_000)]
    long, stem = "verylongwordoftwentyfiveletters", "x" * 70
    html = " ".join(["bcd", "dfg", long, long] * 3 + rare)
    pages = [(1, f"http://{long}.com/en/{stem}a", html), (2, f"http://{rare[-1]}{rare[5]}.net/de/{stem}b", None), (3, "http://bcd9dfg.com/en/77", "")]
    pages += [(4, f"http://{long}dfg{rare[7]}.info/{stem}a", "x"), (5, f"http://q.info/{stem}b-12", "x"), (6, None, "x"), (7, f"http://{rare[-1]}{rare[5]}.info", "x"), (7, f"http://{rare[-1]}{rare[5]}.info", "x")]
    words = defaultdict(int)
    for w in (html + " x x x x x").split():
        words[w] += 1
    total = sum(words.values())
    unseen = math.log(total) + 2

    def split(run):
        best = [(0.0, [])]
        for e in range(1, len(run) + 1):
            best.append(min(((best[s][0] + (-math.log(words[run[s:e]] / total) if run[s:e] in words else unseen + 4 * (e - s)), [*best[s][1], run[s:e]]) for s in range(e - 1, -1, -1)), key=lambda c: c[0]))
        return best[-1][1]

    def tokens(url):
        host, _, path = (url or "").partition("://")[2].partition("/")
        runs = "".join(c if c.islower() else " " for c in host).split()
        pieces = [p for p in path.replace("-", "/").replace(".", "/").split("/") if p]
        return ["h:" + w for run in runs for w in split(run)] + ["p:" + (f"#{len(p)}" if p.isdigit() else p) for p in pieces]

    said = {1: "block", 2: "allow", 3: "block"}
    seen = {v: defaultdict(int) for v in ("allow", "block")}
    for i, u, _ in pages:
        for t in tokens(u) if i in said else ():
            seen[said[i]][t] += 1
    kinds = len(seen["allow"].keys() | seen["block"].keys())
    size = {v: sum(seen[v].values()) + kinds + 1 for v in seen}
    want = {i: math.log(3 / 5) - math.log(2 / 5) + sum(math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"]) for t in tokens(u)) for i, u, _ in pages}
    for few in (100_000, 0):
        monkeypatch.setattr(urlfilter, "SMALL_ROWS", few, raising=False)
        got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
        assert len(got) == len(pages)
        for x in got:
            assert abs(x["block_log_odds"] - want[x["page_id"]]) < 1e-9, x
            assert x["verdict"] == said.get(x["page_id"], "block" if want[x["page_id"]] > 0 else "allow")
