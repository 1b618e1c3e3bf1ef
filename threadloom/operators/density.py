"""Density clustering with noise: neighbours, mutual reachability, spanning tree, hierarchy, clusters of most mass.

The hierarchy of single linkage is built from the rounds that find the spanning tree.  In a round every
component takes its lightest outer edge and the components so joined become one.  An edge that was taken in
round j lies in a component of every later round; it climbs from its component to the next round's until
that component's own outer edge is heavier.  All edges that stop at one component make a chain: each merges
what the lighter ones have merged, so in the order of weight an edge's parent is the next one of its chain,
and the last one's is the component's outer edge.  No step holds a component in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as S
from .numbering import numbered, running

#: Vectors that are compared with each other, and how often they are dealt anew.
BLOCK_ROWS, TABLES = 512, 12
#: Signs of random projections that order vectors.
SIGNS = 24
#: Distances below count as this, so that equal vectors have a finite density.
LEAST_DISTANCE = 1e-12
#: Clusters of the condensed tree that one task may hold; more are taken height by height.
TREE_ROWS = 200_000
NOISE = -1


def points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): the vectors at length 1 (a null vector of zeros stays), stored; rows without id, with a null or non-finite entry, without entries or of another length than most are left out."""
    good = F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = S.stored(df.where(good).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("vec")))
    size = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("n")).first()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c))
    unit = F.transform("vec", lambda c: c / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0))
    return S.stored(rows.where(F.size("vec") == (size["n"] if size else 0)).withColumn("_n", norm).select("id", unit.alias("vec")).groupBy("id").agg(F.min("vec").alias("vec")))


def copies(pts: DataFrame) -> DataFrame:
    """(id, rep, mult): the least id of an equal vector, and how many have it."""
    reps = pts.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    return S.stored(pts.join(reps, "vec").select("id", "rep", "mult", "vec"))


def neighbours(reps: DataFrame, k: int, block_rows: int = BLOCK_ROWS, tables: int = TABLES, seed: int = 42) -> DataFrame:
    """(id, near): the k nearest found of each vector as an array of (d, id, mult), nearest first, stored.

    ``reps`` has (id, vec, mult), no vector twice.  Vectors are ordered by the signs of random projections and
    cut into blocks of ``block_rows``, ``tables`` times over with other projections; the vectors of a block
    are compared with each other, so a block is bounded whatever the data.  Up to ``block_rows`` vectors are
    one block, and the neighbours are exact.
    """
    n = reps.count()
    tables = 1 if n <= block_rows else tables

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if not len(x):
                continue
            v = np.stack(x["vec"])
            for t in range(tables):
                z = v @ np.random.default_rng([seed, t]).normal(size=(v.shape[1], SIGNS))
                sign = (z > 0) @ (1 << np.arange(SIGNS - 1, -1, -1))
                yield pd.DataFrame({"t": t, "sign": sign, "along": z[:, 0], "id": x["id"], "mult": x["mult"], "vec": [r.tobytes() for r in v]})

    rows = reps.select("id", "mult", "vec").mapInPandas(dealt, "t int, sign long, along double, id long, mult long, vec binary")
    placed = numbered(rows, ["sign", "along", "id"], within=("t",), out="at")
    # Every second table is cut half a block later.
    block = F.expr(f"(at + (t % 2) * {block_rows // 2}) div {block_rows}") if tables > 1 else F.lit(0).cast("long")

    def nearest(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id")
        v = np.stack([np.frombuffer(r) for r in x["vec"]])
        ids, mult = x["id"].to_numpy(), x["mult"].to_numpy()
        m = min(k, len(ids) - 1)
        out = []
        for i in range(len(ids)):
            # Differences, not products: a pair then has one distance from both ends and in every block.
            d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            top = np.argpartition(d, m - 1)[:m] if 0 < m < len(ids) - 1 else np.flatnonzero(np.arange(len(ids)) != i)
            reach = np.flatnonzero(d <= d[top].max()) if m else top
            top = reach[np.lexsort((ids[reach], d[reach]))][:m]
            out.append([(d[j], ids[j], mult[j]) for j in top])
        return pd.DataFrame({"id": ids, "near": out})

    near = "array<struct<d:double,id:long,mult:long>>"
    found = placed.select("t", block.alias("block"), "id", "mult", "vec").groupBy("t", "block").applyInPandas(nearest, f"id long, near {near}")
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return S.stored(found.groupBy("id").agg(F.slice(all_, 1, k).alias("near")))


def recall(reps: DataFrame, found: DataFrame, k: int, every: int = 100) -> float:
    """The share of true nearest neighbours that were found, over the vectors whose id ``every`` divides; ties count as found."""
    asked = reps.where(F.col("id") % every == 0).select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    square = F.aggregate(F.zip_with("qv", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = F.array_sort(F.collect_list(F.round(F.sqrt(square), 9)))
    true = reps.join(F.broadcast(asked), F.col("id") != F.col("q")).groupBy("q").agg(F.get(far, F.least(F.lit(k), F.size(far)) - 1).alias("reach"), F.least(F.lit(k), F.count("*")).alias("want"))
    hits = F.size(F.filter("near", lambda x: F.round(x["d"], 9) <= F.col("reach")))
    return float(true.join(found, true["q"] == found["id"]).agg((F.sum(F.least(hits, "want")) / F.sum("want")).alias("r")).first()["r"])


def reachability(members: DataFrame, found: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w), a < b, stored: the mutual reachability of neighbours, and of copies with their representative.

    The core distance of a vector is that of its ``min_samples``-th neighbour, copies counted; of fewer
    neighbours the farthest one's.
    """
    reps = members.where("id = rep").select("id", "mult")
    acc = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    grown = F.aggregate("near", acc.withField("n", F.col("mult") - 1), lambda s, x: F.when(s["n"] >= min_samples, s).otherwise(F.struct((s["n"] + x["mult"]).alias("n"), x["d"].alias("d"))))
    core = S.stored(reps.join(found, "id").select("id", grown["d"].alias("core"), "near"))
    pairs = core.select("id", F.explode("near").alias("x")).select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b"), F.col("x.d").alias("d"))
    pairs = pairs.groupBy("a", "b").agg(F.min("d").alias("d"))
    own = core.select(F.col("id").alias("_v"), "core")
    for end in "ab":
        pairs = pairs.join(own.select(F.col("_v").alias(end), F.col("core").alias(f"c{end}")), end)
    stars = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).join(own.select(F.col("_v").alias("a"), F.col("core").alias("w")), "a", "left")
    return S.stored(pairs.select("a", "b", F.greatest("d", "ca", "cb").alias("w")).unionByName(stars.select("a", "b", F.coalesce("w", F.lit(0.0)).alias("w"))))


def settled(pointers: DataFrame) -> DataFrame:
    """(c, to) with every pointer followed to its end, which points to itself; each pass doubles what a pointer spans."""
    while True:
        ends = pointers.select(F.col("c").alias("_c"), F.col("to").alias("_to"))
        pointers = S.stored(pointers.join(ends, F.col("to") == F.col("_c"), "left").select("c", F.coalesce("_to", "to").alias("to"), (F.coalesce("_to", "to") != F.col("to")).alias("_moved")))
        if not pointers.where("_moved").limit(1).count():
            return pointers.select("c", "to")
        pointers = pointers.select("c", "to")


def spanning_rounds(edges: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Of each round (outer, joined): every component's lightest outer edge (c, w, a, b), and the component (c, to) that it is part of afterwards.

    Edges of one weight are told apart by their ends, so no round has a cycle.  The number of components at
    least halves; between two components only the lightest edge goes on.
    """
    live = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b")
    rounds = []
    while True:
        both = live.select(F.col("x").alias("c"), F.struct("w", "a", "b", F.col("y").alias("other")).alias("e")).unionByName(live.select(F.col("y").alias("c"), F.struct("w", "a", "b", F.col("x").alias("other")).alias("e")))
        best = S.stored(both.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        if not best.limit(1).count():
            return rounds
        back = best.select(F.col("c").alias("other"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        mutual = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("c") < F.col("other"))
        joined = settled(best.join(back, "other").select("c", F.when(mutual, F.col("c")).otherwise(F.col("other")).alias("to")))
        rounds.append((best.select("c", "w", "a", "b"), joined))
        for end in "xy":
            live = live.join(joined.select(F.col("c").alias(end), F.col("to").alias(f"_{end}")), end)
        live = live.where("_x <> _y").select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"), F.struct("w", "a", "b").alias("e"))
        live = S.stored(live.groupBy("x", "y").agg(F.min("e").alias("e")).select("x", "y", "e.*"))


def hierarchy(rounds: list[tuple[DataFrame, DataFrame]], least: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): the merges (eid, w, size, parent, big, split), and of each vertex the merge that it first takes part in (id, eid).

    eids number the tree's edges by weight.  A merge is big that has ``least`` vertices, and a split where
    both its parts have; parent is null at a root.
    """
    chosen = [best.select("a", "b", "w", "c", F.lit(j).alias("round")) for j, (best, _) in enumerate(rounds)]
    tree = chosen[0]
    for more in chosen[1:]:
        tree = tree.unionByName(more)
    edges = S.stored(numbered(tree.groupBy("a", "b").agg(F.min("w").alias("w"), F.min(F.struct("round", "c")).alias("at")).select("a", "b", "w", "at.*"), ["w", "a", "b"], out="eid"))
    ids = edges.select("a", "b", "eid")
    outer = [S.stored(best.join(ids, ["a", "b"]).select("c", F.col("eid").alias("up"))) for best, _ in rounds]
    # Edges climb to the component whose outer edge is heavier.
    chains, climbing = [], None
    for j, (_, joined) in enumerate(rounds):
        new = edges.where(F.col("round") == j).select("eid", "w", "c")
        here = (new if climbing is None else climbing.unionByName(new)).join(joined, "c").select("eid", "w", F.col("to").alias("c"))
        if j + 1 < len(rounds):
            here = here.join(outer[j + 1], "c", "left")
        else:
            here = here.withColumn("up", F.lit(None).cast("long"))
        here = S.stored(here)
        stays = F.col("up").isNull() | (F.col("eid") < F.col("up"))
        chains.append(here.where(stays))
        climbing = here.where(~stays).select("eid", "w", "c")
    # Sizes: what hangs on an edge, and in its chain all lighter ones' as well.
    leaves = outer[0].select(F.col("c").alias("id"), F.col("up").alias("eid"))
    hung = leaves.groupBy("eid").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bigs"))
    nodes = None
    for chain in chains:
        on = hung.groupBy("eid").agg(F.sum("n").alias("n"), F.sum("bigs").alias("bigs"))
        x = running(S.stored(chain.join(on, "eid", "left").withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "bigs": F.coalesce("bigs", F.lit(0)).cast("long")})), ["eid"], ("c",), "n", "size")
        x = S.stored(x.withColumns({"parent": F.coalesce("_next", "up"), "last": F.col("_next").isNull(), "split": F.col("bigs") + (F.col("size") - F.col("n") >= least).cast("long") >= 2}))
        tops = x.where(F.col("last") & F.col("parent").isNotNull()).select(F.col("parent").alias("eid"), F.col("size").alias("n"), (F.col("size") >= least).cast("long").alias("bigs"))
        hung = S.stored(hung.unionByName(tops))
        part = x.select("eid", "w", "size", "parent", (F.col("size") >= least).alias("big"), "split")
        nodes = part if nodes is None else nodes.unionByName(part)
    return S.stored(nodes), leaves


def condensed(nodes: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, falls), stored: (cluster, parent, birth, size, stability), and of each point the cluster and the density at which it falls out (id, cluster, density).

    A cluster begins at a root or below a split and is called by its uppermost merge; small parts fall out of it.
    Points of trees that are small as a whole belong to no cluster.
    """
    density = lambda w: 1 / F.greatest(w, F.lit(LEAST_DISTANCE))
    big = nodes.where("big")
    above = nodes.select(F.col("eid").alias("_p"), F.col("w").alias("_w"), F.col("split").alias("_split"))
    big = S.stored(big.join(above, F.col("parent") == F.col("_p"), "left").withColumn("top", F.col("parent").isNull() | F.col("_split")))
    cluster = settled(big.select(F.col("eid").alias("c"), F.when(F.col("top"), F.col("eid")).otherwise(F.col("parent")).alias("to"))).withColumnsRenamed({"c": "eid", "to": "cluster"})
    tops = big.where("top").select(F.col("eid").alias("cluster"), F.col("parent").alias("_over"), "size", F.when(F.col("parent").isNull(), 0.0).otherwise(density(F.col("_w"))).alias("birth"))
    over = cluster.select(F.col("eid").alias("_over"), F.col("cluster").alias("parent"))
    tops = S.stored(tops.join(over, "_over", "left").select("cluster", "parent", "birth", "size"))
    # A point belongs to the first big merge above it.
    climb = settled(nodes.select(F.col("eid").alias("c"), F.when(F.col("big") | F.col("parent").isNull(), F.col("eid")).otherwise(F.col("parent")).alias("to")))
    first = leaves.join(climb, leaves["eid"] == climb["c"]).select("id", F.col("to").alias("eid"))
    falls = S.stored(first.join(big.select("eid", "w"), "eid").join(cluster, "eid").select("id", "cluster", density(F.col("w")).alias("density")))
    mass = falls.groupBy("cluster").agg(F.sum("density").alias("own"), F.count("*").alias("n"))
    parts = tops.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("birth") * F.col("size")).alias("given"), F.sum("size").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    stable = zero("own") + zero("given") - F.col("birth") * (zero("n") + zero("m"))
    return S.stored(tops.join(mass, "cluster", "left").join(parts, "cluster", "left").select("cluster", "parent", "birth", "size", stable.alias("stability"))), falls


def _chosen_at_once(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen) of a tree that one task may hold."""

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(x["cluster"], x["parent"], strict=True))
        worth = dict(zip(x["cluster"], x["stability"], strict=True))
        below: dict[int, list[int]] = {}
        for c, p in parent.items():
            if p == p and p is not None:
                below.setdefault(int(p), []).append(c)
        roots = [c for c in parent if c not in {k for v in below.values() for k in v}]
        order = list(roots)
        for c in order:
            order += below.get(c, [])
        keep = {}
        for c in reversed(order):
            under = sum(worth[k] for k in below.get(c, []))
            keep[c] = under <= worth[c]
            worth[c] = max(worth[c], under)
        if len(roots) == 1:
            keep[roots[0]] = False
        chosen = {}
        for c in order:
            p = parent[c]
            up = chosen.get(int(p)) if p == p and p is not None else None
            chosen[c] = up if up is not None else (c if keep[c] else None)
        return pd.DataFrame({"cluster": order, "chosen": pd.array([chosen[c] for c in order], "Int64")})

    return clusters.select("cluster", "parent", "stability").groupBy().applyInPandas(choose, "cluster long, chosen long")


def _chosen_by_height(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen): worths go up from the leaves and choices down from the roots, a height at a time."""
    one_root = clusters.where("parent is null").limit(2).count() == 1
    rest, done = clusters.select("cluster", "parent", "stability"), None
    while rest.limit(1).count():
        waits = rest.where("parent is not null").select(F.col("parent").alias("cluster")).distinct()
        ready = rest.join(waits, "cluster", "left_anti")
        if done is not None:
            under = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("worth").alias("under"))
            ready = ready.join(under, "cluster", "left")
        else:
            ready = ready.withColumn("under", F.lit(None).cast("double"))
        u = F.coalesce("under", F.lit(0.0))
        ready = S.stored(ready.select("cluster", "parent", F.greatest("stability", u).alias("worth"), ((u <= F.col("stability")) & ~(F.col("parent").isNull() & F.lit(one_root))).alias("keep")))
        done = ready if done is None else S.stored(done.unionByName(ready))
        rest = S.stored(rest.join(ready.select("cluster"), "cluster", "left_anti"))
    level = done.where("parent is null").select("cluster", F.when(F.col("keep"), F.col("cluster")).alias("chosen"))
    out = None
    while level.limit(1).count():
        level = S.stored(level)
        out = level if out is None else S.stored(out.unionByName(level))
        up = level.select(F.col("cluster").alias("parent"), F.col("chosen").alias("_up"))
        level = done.join(up, "parent").select("cluster", F.coalesce("_up", F.when(F.col("keep"), F.col("cluster"))).alias("chosen"))
    return out


def most_mass(clusters: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(cluster, chosen): the uppermost cluster above it, or itself, that has at least its parts' mass; null where there is none.

    A tree's only root is never chosen.
    """
    return _chosen_at_once(clusters) if clusters.count() <= tree_rows else _chosen_by_height(clusters)


def clustered(df: DataFrame, key: str, vector: str, least: int = 30, min_samples: int | None = None, k: int | None = None, block_rows: int = BLOCK_ROWS, tables: int = TABLES, seed: int = 42, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(key, label) of every usable vector at length 1: clusters of ``least`` points at least, numbered from 0 by their least key; -1 is noise.

    ``min_samples`` (``least`` unless given) neighbours make a core distance, ``k`` (as many) neighbours of
    each vector the graph.  Vectors that the graph doesn't connect are in different clusters.  Left out are
    rows without key, with a null vector, null or non-finite entries or another length than most; of a key
    that is there more than once the least vector counts.  Equal vectors have one label.
    """
    min_samples = min_samples or least
    members = copies(points(df, key, vector))
    none = df.sparkSession.createDataFrame([], "id long, chosen long")
    label = none
    if members.limit(2).count() > 1:
        found = neighbours(members.where("id = rep").select("id", "vec", "mult"), k or min_samples, block_rows, tables, seed)
        nodes, leaves = hierarchy(spanning_rounds(reachability(members, found, min_samples)), least)
        clusters, falls = condensed(nodes, leaves)
        if clusters.limit(1).count():
            label = S.stored(falls.join(most_mass(clusters, tree_rows), "cluster").where("chosen is not null").select("id", "chosen"))
    names = numbered(label.groupBy("chosen").agg(F.min("id").alias("_least")), ["_least"], out="label")
    told = label.join(names.select("chosen", "label"), "chosen").select("id", "label")
    return members.select("id").join(told, "id", "left").select(F.col("id").alias(key), F.coalesce("label", F.lit(NOISE)).cast("long").alias("label"))
