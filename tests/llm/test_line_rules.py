"""Line rules against plain Python: hot hosts and lines, copies, odd characters, both ways of joining frequent lines, cleaned texts, empty tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from threadloom.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    twice = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(twice)


def name(line):
    return re.sub("[0-9]", "0", " ".join(WORD.findall(line)).translate(UP))


def brute(rows, least, share, most=50):
    """(doc_id, stats, base_failed, removed words, removed lines, kept) of [(doc_id, text, source)]."""
    texts, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        hosts[s].add(t or "")
        for line in (t or "").split("\n"):
            texts[s, name(line)].add(t)
    out = []
    for d, t, s in rows:
        b = base(t)
        gone = [i for i, line in enumerate((t or "").split("\n")) if name(line) and len(texts[s, name(line)]) > max(least, share * len(hosts[s]))]
        lost = sum(len(WORD.findall(t.split("\n")[i])) for i in gone)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        out.append((d, *b, failed, lost, tuple(gone), not failed and b[0] - lost >= 20 and 100 * lost <= most * b[0]))
    return out


def documents():
    r = random.Random(11)
    words = ["alpha", "beta", "Gamma", "délta", "ε", "#tag", "a&b", "$5", "<p>", "x|y", "word glued"]
    say = lambda n: " ".join(r.choice(words) + (str(r.randint(0, 9)) if r.random() < 0.2 else "") + r.choice("abcdefghijk") * r.randint(0, 3) for _ in range(n))
    rows = []
    for i in range(120):
        lines = [say(r.randint(3, 25)) for _ in range(r.randint(1, 5))]
        if i % 3:
            lines.insert(r.randint(0, len(lines)), f"All  Rights reserved {i % 10} ")
        if i % 10 == 0:
            lines = ["menu home about", *lines[:1], "footer line of the site with many words in it for sure"] * 2
        rows.append((i, "\n".join(lines), r.choice(["hot", "hot", "b", None, ""])))
    copy = say(30) + "\nown line of a copy"
    rows += [(200 + i, copy, "hot") for i in range(40)]  # one text: its lines aren't frequent
    rows += [(300, None, "hot"), (301, "", "hot"), (302, " \n\t\n", "b"), (303, "a b c d e f g h " * 3, "b"), (304, "one\r\none\none\n\n\x0bone", "b"), (None, say(25), "b"), (200, copy, "hot"), (5, say(40), "b")]
    rows += [(400, "\n".join(say(12) for _ in range(4000)), "b"), (401, "A" * 100_000 + " " + "é" * 300 + "\n" + "A" * 100_000, "b"), (402, say(25) + "\n" + "é" * 300, "b")]
    return rows


ROWS = documents()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n long, lines string").repartition(4)


def plain(got):
    return Counter((r["doc_id"], *[r[c] for c in STATS], r["base_failed"], r["n_removed_words"], tuple(r["removed"]), r["kept"]) for r in got)


@pytest.mark.parametrize(("least", "share", "broadcast"), [(10, 0.02, 1_000_000), (2, 0.1, 1_000_000), (2, 0.0, 1), (3, 0.0, 2)])
def test_against_plain_python(spark, least, share, broadcast):
    got = line_rules.judge(frame(spark, ROWS), least=least, share=share, most_broadcast=broadcast).collect()
    want = brute(ROWS, least, share)
    assert plain(got) == Counter(want)
    assert {True, False} <= {w[-1] for w in want} and any(w[8] for w in want)
    assert all(not w[8] or "own line" not in (t or "") for w, (_, t, _) in zip(want, ROWS, strict=True))


def test_blocks_end_anywhere(spark, monkeypatch):
    monkeypatch.setattr(line_rules.B.text_blocks, "__defaults__", ("text", 300))
    import pyarrow as pa

    texts = [t for _, t, _ in ROWS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["h"] * len(texts)), pa.array(["k"] * len(texts)), pa.array(texts)], names=["doc_id", "host", "text_key", "text"])
    got = [r for b in line_rules._measured(iter([batch])) for r in b.to_pylist()]
    assert [tuple(r[c] for c in STATS) for r in got] == [base(t) for t in texts]


def test_cleaned(spark):
    docs = frame(spark, ROWS)
    got = line_rules.cleaned(docs, line_rules.judge(docs, least=2, share=0.0)).collect()
    want = Counter()
    for (d, t, s), w in zip(ROWS, brute(ROWS, 2, 0.0), strict=True):
        if w[-1]:
            want[d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in w[8]), s] += 1
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == want and got[0]["lines"] == "x"


def test_empty(spark):
    docs = frame(spark, ROWS[:2]).limit(0)
    assert line_rules.judge(docs).collect() == [] and line_rules.cleaned(docs, line_rules.judge(docs)).collect() == []
