"""Conversation trees: roots, and the longest path from a root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources import tables

#: A thread of more rows than this is not walked in one task.
MOST_ROWS = 1_000_000


def roots(nodes: DataFrame, thread: str, node: str, parent: str) -> DataFrame:
    """Nodes without a parent or whose parent isn't in the thread."""
    known = nodes.select(F.col(thread), F.col(node).alias(parent))
    return nodes.join(known, [thread, parent], "left_anti").select(*nodes.columns)


def main_path(nodes: DataFrame, thread: str, node: str, parent: str, ts: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """(thread, pos, node) of each thread's longest root-to-leaf path.

    Ties go, at the highest place where paths part, to the earlier child (no time counts as latest, equal
    times go by id).  A cycle without a root yields no path but from a thread's first node by id; a node is
    visited once.  Rows without a node id are left out, a null thread is a thread; of several rows with one id
    the earliest counts, then the one of the least parent.  Each thread of up to ``most_rows`` rows is one
    group, whose work is linear in its nodes; larger ones are walked by joins, whose number grows with the
    logarithm of their depth and which hold no thread in one task.
    """
    is_time = "timestamp" in nodes.schema[ts].dataType.simpleString()
    secs = F.col(ts).cast("timestamp").cast("double") if is_time else F.col(ts).cast("double")
    secs = F.when(~F.isnan(secs), secs)
    rows = nodes.where(F.col(node).isNotNull()).select(thread, node, parent, secs.alias(ts))
    sizes = tables.stored(rows.groupBy(thread).agg(F.count("*").alias("rows")).where(F.col("rows") > most_rows))
    largest = sizes.agg(F.max("rows").alias("n")).first()["n"]
    if largest is None:
        return _grouped_path(rows, thread, node, parent, ts)
    big = sizes.select(F.col(thread).alias("_big"))
    same = F.col(thread).eqNullSafe(F.col("_big"))
    few = _grouped_path(rows.join(big, same, "left_anti"), thread, node, parent, ts)
    return few.unionByName(_joined_path(rows.join(big, same, "left_semi"), largest, thread, node, parent, ts))


def _grouped_path(rows: DataFrame, thread: str, node: str, parent: str, ts: str) -> DataFrame:
    """The main path, each thread in one group."""
    import pandas as pd

    out = StructType([rows.schema[thread], StructField("pos", LongType()), rows.schema[node]])

    def walk(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values([ts, parent]).drop_duplicates(node)
        when = {n: (t if t == t and t is not None else float("inf"), n) for n, t in zip(x[node], x[ts], strict=True)}
        up = {n: p for n, p in zip(x[node], x[parent], strict=True)}
        down: dict = {}
        tops = []
        for n, p in up.items():
            (down.setdefault(p, []) if p in up and p != n else tops).append(n)
        tops = tops or [min(up)]
        order, seen, stack = [], set(), list(tops)
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                order.append(n)
                stack += [c for c in down.get(n, []) if c not in seen]
        depth, best = {}, {}
        for n in reversed(order):
            kids = [c for c in down.get(n, []) if c in depth]
            best[n] = min(kids, key=lambda c: (-depth[c], when[c])) if kids else None
            depth[n] = 1 + (depth[best[n]] if kids else 0)
        at = min((t for t in tops if t in depth), key=lambda t: (-depth[t], when[t]))
        path = []
        while at is not None:
            path.append(at)
            at = best[at]
        return pd.DataFrame({thread: [x[thread].iloc[0]] * len(path), "pos": range(len(path)), node: path})

    return rows.groupBy(thread).applyInPandas(walk, out)


def _doubled(state: DataFrame) -> DataFrame:
    """(t, n, up, steps) with each link twice as long: a row whose ``up`` isn't among the rows goes, one without stays."""
    ahead = state.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
    on = F.col("t").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2"))
    moved = state.where(F.col("up").isNotNull()).join(ahead, on).select("t", "n", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"))
    return moved.unionByName(state.where(F.col("up").isNull()))


def _linked(state: DataFrame, rounds: int) -> DataFrame:
    """(t, n, steps) of the rows from which links lead to a row without one, by list ranking; what is on a cycle or hangs on one goes."""
    for _ in range(rounds):
        if state.where(F.col("up").isNotNull()).isEmpty():
            break
        state = tables.stored(_doubled(state))
    return state.where(F.col("up").isNull()).select("t", "n", "steps")


def _ancestors(state: DataFrame, rounds: int) -> DataFrame:
    """(t, n) of the marked rows of (t, n, up, mark) and of all their ancestors."""
    for _ in range(rounds):
        if state.where(F.col("up").isNotNull()).isEmpty():
            break
        ahead = state.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("up").alias("up2"))
        met = state.where(F.col("mark") & F.col("up").isNotNull()).select(F.col("t").alias("t3"), F.col("up").alias("n3"), F.lit(True).alias("met")).distinct()
        far = state.join(ahead, F.col("t").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")), "left")
        far = far.join(met, F.col("t").eqNullSafe(F.col("t3")) & (F.col("n") == F.col("n3")), "left")
        state = tables.stored(far.select("t", "n", F.col("up2").alias("up"), (F.col("mark") | F.col("met").isNotNull()).alias("mark")))
    return state.where("mark").select("t", "n")


def _joined_path(rows: DataFrame, largest: int, thread: str, node: str, parent: str, ts: str) -> DataFrame:
    """The main path of threads of up to ``largest`` rows by joins alone.

    Pointer jumping gives depths.  The nodes above a thread's deepest ones are those that the path can pass; each
    names its first child among them, and the path is what hangs together by such names from the first root.
    """
    rounds = max(largest, 2).bit_length()
    late = F.coalesce(F.col("ts"), F.lit(float("inf")))
    known = rows.select(F.col(thread).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p"), F.col(ts).alias("ts"))
    first = F.min(F.struct(late.alias("late"), F.col("p").isNull().alias("none"), "p")).alias("r")
    known = tables.stored(known.groupBy("t", "n").agg(first).select("t", "n", F.when(F.col("r.p") != F.col("n"), F.col("r.p")).alias("p"), F.col("r.late").alias("late")))
    there = known.select(F.col("t").alias("t2"), F.col("n").alias("n2"))
    inside = known.join(there, F.col("t").eqNullSafe(F.col("t2")) & (F.col("p") == F.col("n2")), "left").select("t", "n", F.col("n2").alias("p"), "late")
    # A thread without a root begins at its first node.
    begin = inside.groupBy("t").agg(F.min("n").alias("least"), F.count_if(F.col("p").isNull()).alias("tops")).where("tops = 0").select(F.col("t").alias("t2"), "least")
    inside = inside.join(begin, F.col("t").eqNullSafe(F.col("t2")) & (F.col("n") == F.col("least")), "left")
    inside = tables.stored(inside.select("t", "n", F.when(F.col("least").isNull(), F.col("p")).alias("p"), "late"))

    depth = _linked(inside.select("t", "n", F.col("p").alias("up"), F.col("p").isNotNull().cast("long").alias("steps")), rounds)
    most = depth.groupBy("t").agg(F.max("steps").alias("most")).select(F.col("t").alias("t2"), "most")
    depth = tables.stored(depth.join(most, F.col("t").eqNullSafe(F.col("t2"))).select("t", "n", "steps", (F.col("steps") == F.col("most")).alias("mark")))
    mine = depth.select(F.col("t").alias("t2"), F.col("n").alias("n2"), "steps", "mark")
    on = F.col("t").eqNullSafe(F.col("t2")) & (F.col("n") == F.col("n2"))
    reached = tables.stored(inside.join(mine, on).select("t", "n", "p", "late", F.col("steps").alias("pos"), "mark"))

    above = _ancestors(reached.select("t", "n", F.col("p").alias("up"), "mark"), rounds).select(F.col("t").alias("t2"), F.col("n").alias("n2"))
    child = reached.join(above, on, "left_semi").groupBy("t", "p").agg(F.min(F.struct("late", "n", "pos")).alias("r")).select("t", F.col("r.n").alias("n"), "p", F.col("r.pos").alias("pos"))
    child = tables.stored(child)
    path = _linked(child.select("t", "n", F.col("p").alias("up"), F.col("p").isNotNull().cast("long").alias("steps")), rounds)
    return path.select(F.col("t").alias(thread), F.col("steps").alias("pos"), F.col("n").alias(node))


def transcript(messages: DataFrame, thread: str, order: str, role: str, when: str, text: str) -> DataFrame:
    """(thread, transcript): the thread's messages as one text, [ROLE] time, text and a blank line each."""
    line = F.concat(F.lit("["), F.upper(role), F.lit("] "), F.col(when), F.lit("\n"), F.col(text), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return messages.groupBy(thread).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("transcript"))
