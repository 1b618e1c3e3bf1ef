"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key descends level by level.  At a node every child draws an exponential of its weight from a hash
of the key and the child's own name, and the key goes to the child with the least draw, so it takes a
child with the share that the child's weight has of its siblings'.  A node's weight is the sum of its
shards' weights.  A change of weights alters the draws of the changed nodes alone: keys move into or out
of the subtrees that hold a changed shard, and a key that stays in an unchanged subtree keeps its shard.
Built of DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

#: Rows of one numbering bucket; the number of buckets follows the table's rows.
SLOT_ROWS = 50_000
#: (region, rack, shard, weight) of every shard.
Tree = list[tuple[int, int, int, float]]
LEVELS = ("region", "rack", "shard")


def layout(shards: int, racks_of: int = 2, regions_of: int = 2) -> Tree:
    """(region, rack, shard, weight) of equal shards, two to a rack and two racks to a region."""
    return [(s // (racks_of * regions_of), s // racks_of, s, 1.0) for s in range(shards)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a new rack of a new region, so that it takes keys from all shards and no other shard gets any."""
    top = [max((leaf[i] for leaf in tree), default=-1) + 1 for i in range(3)]
    return [*tree, (*top, weight)]


def draw(key: Column, level: str, node: int, weight: float) -> Column:
    """-ln(u) / weight of a uniform u in (0, 1) from the key's hash with the node."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("hash-tree"), F.lit(level), key, F.lit(node)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def descend(df: DataFrame, key: Column, tree: Tree, names: Sequence[str] = LEVELS) -> DataFrame:
    """Adds a column for each level, the node that the key descends to; ``key`` must not be one of them.

    At each level only the children of the node chosen above it draw.  Of equal draws the least node wins.
    """
    above: list[tuple[int, ...]] = [()]
    for depth, (level, name) in enumerate(zip(LEVELS, names, strict=True)):
        chosen = None
        below = []
        for path in above:
            own = sorted({leaf[: depth + 1] for leaf in tree if leaf[:depth] == path})
            below += own
            if len(own) == 1:
                node = F.lit(own[0][-1])
            else:
                weights = [sum(leaf[3] for leaf in tree if leaf[: depth + 1] == p) for p in own]
                node = F.array_min(F.array(*[F.struct(draw(key, level, p[-1], w).alias("draw"), F.lit(p[-1]).alias("node")) for p, w in zip(own, weights, strict=True)]))["node"]
            if not path:
                chosen = node
            else:
                here = F.col(names[depth - 1]) == path[-1]
                chosen = F.when(here, node) if chosen is None else chosen.when(here, node)
        df = df.withColumn(name, chosen)
        above = below
    return df


def assign(docs: DataFrame, shards: int = 8, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``key``.

    size: UTF-8 bytes plus 1 (null text: none, and crc32 of no bytes).  grown_shard: the shard in the
    ``grown`` tree.  Slots are gapless in a shard: keys are dealt into hash buckets of about
    ``slot_rows`` rows, numbered in each by (doc_id, crc, size), and offset by the counts of the buckets
    before, so no task sees a whole shard.  Repeated ids share a shard and get different slots; a null id
    hashes like any value.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = rows.count()
    buckets = max(1, -(-n // (slot_rows * shards)))
    tree = layout(shards)
    keyed = descend(rows, F.col("doc_id"), tree).withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if buckets * shards <= B.BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    sized = keyed.select("doc_id", "shard", "_bucket", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    full = descend(sized, F.col("doc_id"), grown(tree), ("grown_region", "grown_rack", "grown_shard"))
    place = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = full.withColumn("_rank", F.row_number().over(place))
    return numbered.join(offsets, ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
