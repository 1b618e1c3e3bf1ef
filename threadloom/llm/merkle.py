"""Merkle manifest of a dataset: parents store their children's hashes, proofs are cut out of them.

A parent's preimage is the concatenation of its children's digests as hex text, 64 characters a child, so
the place of a child in its run is the place of its slot in the preimage.  A leaf joins the preimages of
its ancestors: the siblings of each level are a preimage without the leaf's own slot, and folding splices
the digest so far into that slot and hashes.  Groups have trees of their own; their subroots, in the order
of the groups, are the leaves of one more tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import blocks

FANOUT = 16
DIGEST = 64
#: Input bytes of one range of the numbering of leaves.
RANGE_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<slot:int,preimage:string>>"


def field(value: Column) -> Column:
    """A value as part of a leaf: its length in UTF-8 bytes, a colon and itself; a null is a dash."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _excised(pre: Column, slot: Column) -> Column:
    return F.concat(F.substr(pre, F.lit(1), slot * DIGEST), F.substr(pre, slot * DIGEST + DIGEST + 1))


def _spliced(pre: Column, slot: Column, own: Column) -> Column:
    return F.concat(F.substr(pre, F.lit(1), slot * DIGEST), own, F.substr(pre, slot * DIGEST + DIGEST + 1))


@dataclass
class Manifest:
    """Stored levels of the trees.

    ``levels[0]`` has the leaves (key, pos, n, digest and what else they carry), ``levels[k]`` the parents of
    level k (key, pos, n, preimage, digest); n is the group's number of leaves.  ``paths`` has a row a group:
    its subroot and the preimages from there to the root.  ``root`` is null for no leaves.
    """

    levels: list[DataFrame]
    paths: DataFrame
    root: str | None


def _height(n: Column) -> Column:
    """Levels of parents above n leaves."""
    steps = [F.when(n > FANOUT**h, F.lit(h + 1)) for h in range(15, -1, -1)]
    return F.coalesce(*steps, F.lit(0))


def _levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The leaves (key, pos, n, digest, ...) and, level by level, the parents of runs of 16; a group ends with the level that has one node."""
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    out, height = [leaves], 0
    while most > FANOUT**height:
        below = out[-1].where(_height(F.col("n")) > height)
        run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        up = below.groupBy("key", F.expr(f"pos div {FANOUT}").alias("_up")).agg(F.first("n").alias("n"), F.array_join(F.transform(run, lambda x: x["digest"]), "").alias("preimage"))
        height += 1
        out.append(blocks.stored(up.select("key", F.col("_up").alias("pos"), "n", "preimage", F.sha2(F.col("preimage").cast("binary"), 256).alias("digest")), f"{name}-{height}"))
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(key, digest) of each group's last node."""
    return reduce(DataFrame.unionByName, [x.where(_height(F.col("n")) == h).select("key", "digest") for h, x in enumerate(levels)])


def _descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their subroot and path: a step (slot, preimage) for each ancestor, lowest first, then the steps ``above`` their group's tree.

    Parents take the path from their own parent, level by level, so a leaf needs one join: with its parent,
    which sixteen leaves share at most.
    """
    down = None
    for h in range(len(levels) - 1, -1, -1):
        own = levels[h].where(_height(F.col("n")) == h).join(above, "key")
        if down is not None:
            lower = levels[h].where(_height(F.col("n")) > h).withColumn("_up", F.expr(f"pos div {FANOUT}"))
            step = F.array(F.struct((F.col("pos") % FANOUT).cast("int").alias("slot"), F.col("_pre").alias("preimage")))
            lower = lower.join(down, ["key", "_up"]).withColumn("path", F.concat(step, F.col("path")))
            own = own.unionByName(lower.select(*own.columns))
        if h:
            down = own.select("key", F.col("pos").alias("_up"), F.col("preimage").alias("_pre"), "subroot", "path")
    return own


def build(leaves: DataFrame, order: list[str], parts: int | None = None) -> Manifest:
    """The manifest of leaves (key, digest, ...): in each group of ``key``, which is never null, they stand in the order of ``order`` and then of their digests.

    Groups stand in the order of the bytes of their key.  No rows give a manifest without a root.
    """
    placed = blocks.stored(numbered(leaves, [*order, "digest"], within=("key",), total="n", parts=parts), "merkle-leaves")
    levels = _levels(placed, "merkle")
    groups = blocks.stored(numbered(_tops(levels), ["key"], total="n").select(F.lit("").alias("key"), F.col("key").alias("group"), "pos", "n", "digest"), "merkle-groups")
    upper = _levels(groups, "merkle-root")
    top = _tops(upper).first()
    start = upper[0].sparkSession.createDataFrame([("", "", [])], f"key string, subroot string, path {_PATH}")
    paths = _descended(upper, start).select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "path")
    return Manifest(levels, blocks.stored(paths, "merkle-paths"), top["digest"] if top else None)


def leaves(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "source", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(key, doc_id, digest, tampered) of each row, stored: the text is read once.

    ``key`` is never null: a null group comes before all others, an empty one next.  Where the column
    ``tampered`` holds, the digest of the row with its text in lower case (A to Z alone) is there as well; else
    it is null.  Null ids are leaves like any other and come first.
    """
    own = [F.col(c) for c in columns]
    other = [lower_ascii(F.col(c)) if c == text else F.col(c) for c in columns]
    changed = F.when(tampered, digest(*other)) if tampered is not None else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    return blocks.stored(docs.select(group.alias("key"), F.col(columns[0]), digest(*own).alias("digest"), changed.alias("tampered")), "merkle-rows")


def siblings(path: Column) -> Column:
    """The siblings' digests of all levels as one text: each preimage without the own slot."""
    return F.array_join(F.transform(path, lambda s: _excised(s["preimage"], s["slot"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(_spliced(s["preimage"], s["slot"], h).cast("binary"), 256))


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its subroot, its root, proof_sha256 (of all siblings up to the root), folded_root and verified.

    ``folded_root`` is folded from the tampered digest where there is one, and ``verified`` says whether it
    is the root.  Rows that are equal in all columns have equal proofs but for the runs they fall in.
    """
    found = _descended(manifest.levels, manifest.paths)
    root = F.lit(manifest.root).cast("string")
    fold = folded(F.coalesce("tampered", "digest"), F.col("path"))
    x = found.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")).cast("binary"), 256), "folded_root": fold})
    keep = [c for c in manifest.levels[0].columns if c not in ("key", "n", "digest", "tampered")]
    return x.select(*keep, F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def audit(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The proofs of all rows of ``docs``: (doc_id, pos, leaf, subroot, root, proof_sha256, folded_root, verified).

    Null fields are part of a leaf; repeated rows are leaves of their own; an empty table gives no rows;
    other columns don't matter, whatever their names.
    """
    parts = blocks.bucket_count(docs, RANGE_BYTES)
    return proofs(build(leaves(docs, tampered=tampered), ["doc_id"], parts))
