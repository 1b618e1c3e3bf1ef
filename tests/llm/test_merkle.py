"""The Merkle manifest against plain Python: hot and lone groups, null fields, repeated rows, over 16 groups, empty tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle

UP = str.maketrans(merkle.UPPER, merkle.LOWER)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """Levels from the leaves to the root."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, pos):
    """(siblings before, siblings after) of each level."""
    out = []
    for level in levels[:-1]:
        a = pos // 16 * 16
        run = level[a : a + 16]
        out.append((run[: pos - a], run[pos - a + 1 :]))
        pos //= 16
    return out


def brute(rows):
    """Counter-like list of the contract's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, r in enumerate(groups[s]):
            path = climb(trees[s], pos) + climb(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf((*r[:4], r[4].translate(UP))) if hit and r[4] is not None else leaf(r)
            for a, b in path:
                h = sha("".join([*a, h, *b]))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(x for a, b in path for x in a + b)), h, h == top[-1][0]))
    return out


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = merkle.audit(df, tampered=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_against_plain_python(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, "hot", r.choice(["en", None]), i, r.choice(["Ab C", "é Ü A", ""]) + "x" * (i % 3) if i % 4 else None) for i in range(300)]
    rows += [(1000 + i, f"s{i:02}", "de", None, f"Text {i}") for i in range(18)]
    rows += [(5, None, None, None, None), (6, "", "en", 3, "lone Text"), (None, "hot", "en", 1, "No Id"), (7, "é", "en", 1, "A" * 100_000)]
    rows += [rows[3], rows[3], (3, "hot", "en", 9, "same id, Other text")]
    want = brute(rows)
    assert plain(run(spark, rows)) == plain(want)
    assert {w[6] for w in want} == {True, False}
    monkeypatch.setattr(merkle.blocks, "bucket_count", lambda *a, **k: 7)  # the group over several ranges
    assert plain(run(spark, rows)) == plain(want)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_sizes_of_one_group(spark, n):
    rows = [(i, "one", "en", i, f"T{i}") for i in range(n)]
    assert plain(run(spark, rows, 2)) == plain(brute(rows))


def test_empty(spark):
    assert run(spark, []) == []


def test_tampering_shows(spark):
    """Any change of a leaf, and of a preimage on its path, changes the folded root."""
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", "en", i, f"Text {i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.build(merkle.leaves(docs), ["doc_id"])
    x = merkle._descended(m.levels, m.paths)
    bad = F.transform(F.col("path"), lambda s: F.struct(s["slot"].alias("slot"), F.concat(s["preimage"], F.lit("0")).alias("preimage")))
    got = x.select(merkle.folded(F.col("digest"), F.col("path")).alias("ok"), merkle.folded(F.reverse("digest"), F.col("path")).alias("leaf"), merkle.folded(F.col("digest"), bad).alias("pre")).collect()
    assert {r["ok"] for r in got} == {m.root} and all(m.root not in (r["leaf"], r["pre"]) for r in got)
