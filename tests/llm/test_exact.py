"""The exact operators against plain Python, with nulls, empty and long texts, ties, repeats and clashing column names."""

import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from threadloom.llm import blocks, decontam, fmindex, media, ngram_join, packing, sharding  # noqa: E402

CLASH = "bucket int, key string, n long, size int, words string, comp long, spans string, _id long, h long, w string, label string, leader long"


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("Ba", "ke", "lo", "mü", "nö", "The", "of") for b in ("", "ra", "sti", "ond", "verylongwordpart", "é")]
    say = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", "", ".", ",\n", "\t"]) for _ in range(n))
    passage, base = say(40), say(150)
    texts = [None, "", " \n\t ", "one", "One", "one two three four", "ONE two three four", "one two three four five", say(3000), say(30) + " " + passage, passage + " " + say(25), passage, base, base, base]
    for _ in range(12):  # near copies
        w = base.split(" ")
        for _ in range(r.choice([0, 1, 2, 3, 9])):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += ["the " * 400, "the " * 300 + say(20), "x" * 700 + " y", say(13), say(12)]
    ids = r.sample(range(-50, 10_000), len(texts))
    return list(zip(ids, texts, strict=True)) + [(ids[12], base)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, *[None] * 12) for d, t in rows], "doc_id long, text string, " + CLASH).repartition(3)


ROWS = corpus()
ITEMS = [("a", " ".join(ROWS[8][1].split()[100:140])), ("b", "One, two! THREE"), ("c", ROWS[11][1]), ("d", ""), ("e", None), ("f", "!!!"), ("g", "y"), ("a2", " ".join(ROWS[8][1].split()[110:125]))]


def test_substring(spark):
    got = fmindex.dedup(frame(spark, ROWS), keep=("text", "key")).collect()
    want = brute.substring(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize(("segments", "most"), [(1, 1 << 20), (4, 2), (1 << 40, 1 << 20)])
def test_substring_split(spark, monkeypatch, segments, most):
    monkeypatch.setattr(fmindex, "SPLIT_SEGMENTS", segments)
    monkeypatch.setattr(fmindex, "SPLIT_MOST", most)
    passage = " ".join(f"p{i}" for i in range(22))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i % 9)) + " " + passage + " " + " ".join(f"e{i}w{j}" for j in range(9 - i % 9))) for i in range(80)]
    rows += [(100 + i, rows[i][1] + (" " + passage) * (i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute.substring(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fmindex.dedup(df).collect()} == want
    split = fmindex.split_minimizers(fmindex.shared_minimizers(df, 8))
    # All minimizers of the passage have one level here, so a short list has none of them.
    assert len(split) <= most and bool(len(split)) == (segments == 1)


def test_substring_repeated_ids(spark):
    """Null and repeated ids keep their rows apart: each text gets its own cuts."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(None, a), (None, b + " tail"), (None, "x y"), (2, a + " z"), (2, b), (2, b), (3, "p q r " + b), (3, a[:20] + " " + a), (4, None)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in fmindex.dedup(frame(spark, rows)).collect())
    assert got == sorted([("None", 30, 0), ("None", 31, 0), ("None", 2, 0), ("2", 31, 30), ("2", 30, 30), ("2", 30, 30), ("3", 33, 30), ("3", 30 + len(a[:20].split()), 30), ("4", 0, 0)])


@pytest.mark.parametrize("most", [8, 1 << 9])
def test_substring_small_filter(spark, monkeypatch, most):
    """A filter too small for its minimizers lets more segments through and changes no result."""
    monkeypatch.setattr(fmindex, "FILTER_BYTES", most)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fmindex.dedup(frame(spark, ROWS)).collect()}
    assert got == brute.substring(ROWS)


def test_substring_many_buckets(spark, monkeypatch):
    """More buckets than partitions: a partition takes several, one after the other."""
    monkeypatch.setattr(blocks, "MOST_PARTITIONS", 3)
    monkeypatch.setattr(fmindex, "SPLIT_SEGMENTS", 2)
    monkeypatch.setattr(fmindex, "SEARCH_ROWS", 5)
    monkeypatch.setattr(fmindex, "KNOWN_WINDOWS", 4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fmindex.dedup(frame(spark, ROWS)).collect()}
    assert got == brute.substring(ROWS)


def test_substring_empty(spark):
    assert fmindex.dedup(frame(spark, ROWS).limit(0)).collect() == []
    assert [r["n_words"] for r in fmindex.dedup(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()] == [2]


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, small, monkeypatch):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, h int")
    if not small:
        real = decontam.hits
        monkeypatch.setattr(decontam, "hits", lambda *a: real(*a, broadcast_windows=0))
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    got = decontam.scan(frame(spark, ROWS), items).collect()
    want = brute.contamination(ROWS, ITEMS)
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in ROWS)
    for r in got:
        assert (r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), len(r["items"])) == want[r["doc_id"]][:3], r
        assert [*r["items"]] == sorted(r["items"])
    assert sum(bool(w[1]) for w in want.values()) > 4


def test_decontamination_repeated_ids(spark):
    """Rows of one id, or of none, come out once each with their own hits."""
    leak = " ".join(f"w{i}" for i in range(12))
    rows = [(3, leak), (3, leak), (3, "x " + leak), (None, leak), (None, "a b"), (None, None), (5, "a b")]
    got = decontam.scan(frame(spark, rows), spark.createDataFrame([("i", leak)], "item_id string, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in got) == sorted(
        [("3", 12, [(0, 12)], ["i"]), ("3", 12, [(0, 12)], ["i"]), ("3", 13, [(1, 13)], ["i"]), ("None", 12, [(0, 12)], ["i"]), ("None", 2, [], []), ("None", 0, [], []), ("5", 2, [], [])]
    )


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    got = decontam.scan(frame(spark, ROWS[:4]), none).collect()
    assert [r["spans"] for r in got] == [[]] * 4
    assert decontam.scan(frame(spark, ROWS).limit(0), none).collect() == []


def _classes(docs, **more):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs, **more).collect())


def test_classes(spark):
    want = brute.classes(ROWS)
    assert _classes(frame(spark, ROWS)) == sorted((d, *want[d]) for d, _ in ROWS)
    assert len({c for _, c in want.values()}) < len(want)


def test_classes_repeated_rows(spark):
    """Every row comes out once: repeated rows, null ids, and an id with several texts, which is one document."""
    rows = [(3, "a"), (5, "a"), (5, "a"), (5, "a"), (7, None), (9, ""), (None, "a"), (None, None)]
    got = ngram_join.components(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(3, 1, 3), (5, 1, 3), (5, 1, 3), (5, 1, 3), (7, 0, 7), (9, 0, 9), (None, 1, None), (None, 0, None)], key=str)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(4, long), (4, "b c"), (6, long + " x"), (8, "b c"), (8, "b c")]
    assert _classes(frame(spark, rows)) == [(4, 1, 4), (4, 56, 4), (6, 57, 4), (8, 1, 8), (8, 1, 8)]


@pytest.mark.parametrize("list_rows", [4_096, 5])
def test_classes_many(spark, monkeypatch, list_rows):
    """Near copies in chains and stars, some linked only through others; long lists in one part or in many."""
    monkeypatch.setattr(ngram_join.list_parts, "__defaults__", (list_rows,))
    if list_rows == 5:
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 3)
        monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
        monkeypatch.setattr(ngram_join, "PAIR_ROWS", 7)
        monkeypatch.setattr(blocks, "MOST_PARTITIONS", 3)  # so a partition has several buckets
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(900)]
    rows, d = [], 0
    for _ in range(12):
        w = [r.choice(vocab) for _ in range(r.choice([12, 40, 90]))]
        for _ in range(r.choice([3, 25])):
            rows.append((d, " ".join(w)))
            d += 1
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocab)
    r.shuffle(rows)
    want = brute.classes(rows)
    assert _classes(frame(spark, rows)) == sorted((d, *want[d]) for d, _ in rows)


def test_connected(spark):
    """Chains, stars and a ring, against a union-find of plain Python."""
    r = random.Random(11)
    names = r.sample(range(10_000), 300)
    edges = [(names[i], names[i + 1]) for i in range(80)] + [(names[100], names[i]) for i in range(101, 160)] + [(names[160 + i], names[160 + (i + 1) % 40]) for i in range(40)]
    edges += [(names[r.randrange(200, 300)], names[r.randrange(200, 300)]) for _ in range(60)] + [(names[299], names[299])]
    parent = {n: n for e in edges for n in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x["node"]: x["comp"] for x in ngram_join.connected(spark.createDataFrame(edges, "a long, b long").repartition(4), 4).collect()}
    assert got == {n: root(n) for n in parent if root(n) != n}


def test_classes_empty(spark):
    assert ngram_join.components(frame(spark, ROWS).limit(0)).collect() == []


def test_media(spark):
    got = media.decode(media.store(frame(spark, ROWS))).collect()
    want = {d: brute.media(t) for d, t in ROWS}
    assert len(got) == len(ROWS)
    feature = {}
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]]
        assert r["media_bytes"] == r["payload_bytes"] + media.HEADER
        assert len(r["pcm16k"]) == 4 * r["payload_bytes"]
        assert feature.setdefault(r["payload_sha256"], (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"])


def test_media_query_returns_pcm(spark, tmp_path):
    """The query's rows carry the resampled PCM, whole: the samples themselves at the even places."""
    from threadloom.llm import queries

    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_media(spark, str(tmp_path)).collect()
    text = dict(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        pcm = np.frombuffer(r["pcm16k"], "<i2")
        raw = (text[r["doc_id"]] or "").encode()
        assert pcm[0::2].tolist() == media.MULAW[list(raw) + [255] * (r["payload_bytes"] - len(raw))].tolist()
        assert r["feature"].endswith(f";pcm16k_crc32={zlib.crc32(r['pcm16k'])}")


def test_resampling():
    """A tone below the old half rate stays itself at twice the rate, and signals don't reach into each other."""
    t = np.arange(1200)
    tone = (9000 * np.sin(2 * np.pi * 0.35 * t)).astype(np.int16)
    both = media.resample_double(np.concatenate([tone, -tone]), np.array([0, 1200, 2400]))
    want = 9000 * np.sin(2 * np.pi * 0.35 * (np.arange(2400) / 2))
    assert np.abs(both[100:2300] - want[100:2300]).max() < 12
    assert both[:2400].tolist() == media.resample_double(tone, np.array([0, 1200])).tolist()
    # No image of the tone above the old half rate.
    power = np.abs(np.fft.rfft(both[:2400] * np.hanning(2400)))
    assert power[640:].max() < power.max() / 500


def test_companding_and_adpcm():
    assert (media.MULAW[0xFF], media.MULAW[0x7F], media.MULAW[0], media.MULAW[0x80]) == (0, 0, -32124, 32124)
    assert (media.ALAW[0xD5], media.ALAW[0x55], media.ALAW[0x2A], media.ALAW[0xAA]) == (8, -8, -32256, 32256)
    x = (8000 * np.sin(np.arange(3 * 1145) / 9)).astype(np.int16).reshape(3, 1145)
    y = media.adpcm_decode(media.adpcm_encode(x).ravel())
    assert y.shape == x.shape and np.abs(y[:, 50:].astype(int) - x[:, 50:]).mean() < 300

    def slow(block):  # one nibble after the other
        pred, index = int(np.int16(np.uint16(block[0] | block[1] << 8))), min(int(block[2]), 88)
        out = [pred]
        for b in block[4:]:
            for nib in (int(b) & 15, int(b) >> 4):
                s = int(media.STEPS[index])
                d = (s >> 3) + (s if nib & 4 else 0) + (s >> 1 if nib & 2 else 0) + (s >> 2 if nib & 1 else 0)
                pred = max(-32768, min(32767, pred - d if nib & 8 else pred + d))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nib & 7]))
                out.append(pred)
        return out

    raw = np.random.default_rng(1).integers(0, 256, (4, 576)).astype(np.uint8)
    assert media.adpcm_decode(raw.ravel()).tolist() == [slow(b.astype(int)) for b in raw]
    assert media.wav_payload(media.wav(b"abc")) == (7, b"abc")
    with pytest.raises(ValueError):
        media.wav_payload(b"RIFF....WAVE")


def test_sharding(spark):
    rows = [(i, "ä" * (i % 5)) for i in range(4000)] + [(7, None), (None, "x")]
    got = sharding.assign(frame(spark, rows), slot_rows=100).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert set(slots) == set(range(8))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert 300 < sum(r["grown_shard"] == 8 for r in got) < 600
    assert all(400 < len(s) < 600 for s in slots.values())
    one = [r for r in got if r["doc_id"] == 3]
    assert one[0]["size"] == 7 and one[0]["text_crc32"] == zlib.crc32("äää".encode())
    assert sharding.assign(frame(spark, rows).limit(0)).collect() == []


def _descended(spark, trees, n=6000):
    df = spark.range(n)
    from pyspark.sql import functions as F

    for i, tree in enumerate(trees):
        df = sharding.descend(df, F.col("id"), tree, [f"{level}{i}" for level in sharding.LEVELS])
    return df.collect()


def test_tree_moves_only_where_weights_change(spark):
    """Keys move into the subtrees of the heavier shard, at every level, and nowhere else."""
    tree = sharding.layout(8)
    heavier = [(g, k, s, 3.0 if s == 5 else w) for g, k, s, w in tree]
    got = _descended(spark, [tree, heavier])
    moved = [r for r in got if r["shard0"] != r["shard1"]]
    # Shard 5 is in rack 2 of region 1: who moves enters that region, or its rack from the region, or the shard from the rack.
    for r in moved:
        assert r["region1"] == 1
        if r["region0"] == 1:
            assert r["rack1"] == 2
        if r["rack0"] == 2:
            assert r["shard1"] == 5
    assert any(r["region0"] == 0 for r in moved) and any(r["rack0"] == 3 for r in moved) and any(r["rack0"] == 2 for r in moved)
    assert abs(sum(r["shard1"] == 5 for r in got) / len(got) - 0.3) < 0.03
    assert all(abs(sum(r["shard1"] == s for r in got) / len(got) - 0.1) < 0.02 for s in range(8) if s != 5)


def test_tree_decides(spark):
    """The tree itself places keys: the same shards under other regions and racks hold other keys, in the same shares."""
    trees = [sharding.layout(8), [(0, 0, s, 1.0) for s in range(8)], [(s % 2, s % 4, s, 1.0) for s in range(8)]]
    got = _descended(spark, trees)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert sum(r[f"shard{i}"] != r[f"shard{j}"] for r in got) > len(got) / 3
    for i in range(3):
        assert all(abs(sum(r[f"shard{i}"] == s for r in got) / len(got) - 1 / 8) < 0.02 for s in range(8))
        where = {s: (g, k) for g, k, s, _ in trees[i]}
        assert all((r[f"region{i}"], r[f"rack{i}"]) == where[r[f"shard{i}"]] for r in got)


def test_tree_grows_by_one(spark):
    for shards in (1, 2, 5, 8, 9):
        got = _descended(spark, [sharding.layout(shards), sharding.grown(sharding.layout(shards))], 2000)
        assert all(r["shard1"] in (r["shard0"], shards) for r in got)
        assert abs(sum(r["shard1"] == shards for r in got) / len(got) - 1 / (shards + 1)) < 0.04


def _tokenizer():
    pt = pytest.importorskip("public_tokenizers")
    return pt.path("byte_bpe_50k.json")


def test_packing(spark):
    path = _tokenizer()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)  # as it comes, with nothing set
    extra = [(20_000, "it's 'tis don't WE'LL  x\n\n y z 日本 <|endoftext|>"), (20_001, "\x1c \x85 ''re 'll'"), (None, "no id"), (None, None), (20_002, "long " * 9000), (20_002, "long " * 9000)]
    rows = ROWS + extra
    cut = packing.stored_pieces(frame(spark, rows), path)
    got = packing.pack(cut, rank_rows=7).collect()
    want = defaultdict(int)
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        at, k = 0, 0
        while at < len(ids):  # the first piece is what is over
            n = (len(ids) - at) % 2048 or 2048
            want[d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    mine, bins = defaultdict(int), defaultdict(list)
    for r in got:
        mine[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert mine == want
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(packing.stored_pieces(frame(spark, rows).limit(0), path)).collect() == []


def test_packing_added_token(spark):
    """The ids are the tokenizer's own, with nothing set, also where a text holds an added token's content."""
    path = _tokenizer()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert t.encode("end <|endoftext|> next", add_special_tokens=False).ids == [437, 220, 50256, 1306]
    texts = ["end <|endoftext|> next", "end next", "<|endoftext|>", "a <|endoftext|><|endoftext|>\n日本", "a <|endof", "text|> b", "endoftext <| |>", "", "é <|endoftext|>" * 900]
    # One block, and texts that hold the content only together.
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, with_ids=True).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        ids[r["doc_id"]] += r["ids"]
    assert ids == {d: t.encode(x, add_special_tokens=False).ids + [0] for d, x in enumerate(texts)}


def test_plan():
    r = np.random.default_rng(2)
    for n in (1, 50, 20_000):
        x, c = np.unique(np.minimum(r.lognormal(5.5, 1.3, n).astype(int) + 1, 2048), return_counts=True)
        plan = packing.plan(dict(zip(x.tolist(), c.tolist(), strict=True)))
        used = defaultdict(int)
        for p, k in plan:
            assert sum(p) <= 2048
            for y in p:
                used[y] += k
        assert used == dict(zip(x.tolist(), c.tolist(), strict=True))
        assert sum(k for _, k in plan) <= -(-int((x * c).sum()) // 2048) * 1.02 + 1
    assert packing.plan({}) == []


def test_sum_index():
    """What it finds makes the sum of available pieces, as few as can be; None only where nothing does, as counts fall."""
    from itertools import combinations_with_replacement

    r = np.random.default_rng(3)
    have = np.zeros(41, np.int64)
    have[[3, 5, 8, 14, 21, 22]] = [2, 1, 4, 1, 2, 1]
    index = packing.SumIndex(have)

    def makes(total):
        return [c for k in (1, 2, 3) for c in combinations_with_replacement(range(1, 41), k) if sum(c) == total and all(have[x] >= c.count(x) for x in c)]

    while have.any():
        for total in r.permutation(np.arange(1, 41)).tolist():
            found, all_ = index.find(total), makes(total)
            assert (found is None) == (not all_), (total, found, all_, have)
            if found:
                assert sum(found) == total and index.available(found) and len(found) == len(all_[0])
        index.reserve((int(r.choice(np.flatnonzero(have))),))
        if r.random() < 0.5:
            pattern, n = index.use()
            assert n >= 1


def _longest(text, pattern, depth):
    """Matching statistics the slow way."""
    out = []
    for i in range(len(pattern)):
        m = 0
        while m < min(depth, len(pattern) - i) and any((text[j : j + m + 1] == pattern[i : i + m + 1]).all() for j in range(len(text) - m)):
            m += 1
        out.append(m)
    return out


@pytest.mark.parametrize("depth", [1, 6, 13])
def test_matching_statistics(depth):
    """Streamed patterns, some with symbols that the text lacks: lengths, and the least owner of every full match."""
    r = np.random.default_rng(depth)
    t = np.minimum(r.zipf(1.5, 400), 9)
    t[::37] = t[-1] = 0
    own = r.integers(0, 1000, len(t))
    ix = fmindex.FMIndex(t, own, depth)
    full = 0
    pats = [t[1:30], *(np.minimum(r.zipf(1.5, n), 11) for n in r.integers(1, 30, 25))]
    size = np.array([len(p) for p in pats])
    length, lo = ix.matches(np.concatenate(pats), np.cumsum(size) - size, size)
    assert length.tolist() == [x for p in pats for x in _longest(t, p, depth)]
    for at, p in zip(np.cumsum(size) - size, pats, strict=True):
        for i in range(len(p) - depth + 1):
            if length[at + i] == depth:
                full += 1
                assert ix.least_owner(lo[at + i : at + i + 1])[0] == min(own[j] for j in range(len(t) - depth + 1) if (t[j : j + depth] == p[i : i + depth]).all())
    assert full > 10


def test_entropy_codes():
    """Prefix-free, and near the text's entropy."""
    count = np.array([0, 900, 1, 300, 40, 40, 7, 1, 0, 2])
    size = fmindex.code_lengths(count)
    code = fmindex.codes(size)
    own = np.flatnonzero(count)
    words = ["".join(str(code[i] >> k & 1) for k in range(size[i])) for i in own]
    assert all(i == j or not b.startswith(a) for i, a in enumerate(words) for j, b in enumerate(words))
    p = count[own] / count.sum()
    assert (p * size[own]).sum() < -(p * np.log2(p)).sum() + 1


def test_segments_of_one_hash():
    """Words decide whether segments are equal, not their common hash."""
    seg = np.array([7, 7, 7, 9], np.uint64)
    h = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 5, 5, 5], np.uint64)
    order, new = fmindex._distinct(seg, np.array([0, 3, 6, 9]), np.array([3, 3, 3, 3]), h)
    assert order.tolist() == [0, 1, 2, 3] and new.tolist() == [True, True, True, True]
    order, new = fmindex._distinct(seg, np.array([0, 6, 3, 9]), np.array([3, 3, 3, 3]), h)
    assert new.tolist() == [True, False, True, True]


def test_word_hashes():
    words = ["a", "b", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 3, "x" * 5000, "x" * 5001]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = blocks.word_spans(blocks.SPACE[raw], np.array([0, len(raw)]))
    h = blocks.word_hashes(raw, s, e)
    assert len(set(h.tolist())) == len(words)
    again = np.frombuffer(("zz " + " ".join(words)).encode(), np.uint8)
    s, e, _ = blocks.word_spans(blocks.SPACE[again], np.array([0, len(again)]))
    assert blocks.word_hashes(again, s, e)[1:].tolist() == h.tolist()


def test_shards_of_minimizers_are_even():
    """The shards of a corpus' minimizers hold much the same number, at many shards as well as at few."""
    import numpy as np

    from threadloom.llm import fmindex

    h = np.random.default_rng(2).integers(0, 1 << 64, 400_000, dtype=np.uint64)
    v, *_ = fmindex.segments(h, np.array([0, len(h)]), fmindex.WINDOW)
    v = np.unique(v)
    for shards in (64, 1 << 12):
        n = np.bincount((fmindex.B.mix(v) % np.uint64(shards)).astype(int), minlength=shards)
        assert n.max() < n.mean() + 6 * n.mean() ** 0.5 and n.min() > n.mean() - 6 * n.mean() ** 0.5
