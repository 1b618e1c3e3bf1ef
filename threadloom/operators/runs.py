"""Order-dependent operators: shifts, runs, count windows, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as S
from . import numbering


def _in_order(df: DataFrame, thread: str, order: list[str], category: str, range_rows: int) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with a category and the one before it as ``_prev``, the columns of a stretch, the order in it).

    Threads of up to ``range_rows`` rows in all are a stretch each.  More rows are numbered by ranges and every
    thread is cut into stretches of that many rows; a stretch's first row gets what the stretch before ended
    with, so a thread of any size is spread over tasks.
    """
    x = df.where(F.col(category).isNotNull())
    if x.count() <= range_rows:
        return x.withColumn("_prev", F.lag(category).over(Window.partitionBy(thread).orderBy(*order))), [thread], order
    x = S.stored(numbering.numbered(x, order, within=(thread,), out="_pos", range_rows=range_rows).withColumn("_stretch", F.expr(f"_pos div {range_rows}")))
    last = x.groupBy(thread, "_stretch").agg(F.max_by(category, "_pos").alias("_last"))
    carried = S.stored(last.select(thread, "_stretch", F.lag("_last").over(Window.partitionBy(thread).orderBy("_stretch")).alias("_carried")))
    x = _joined(x, carried, thread)
    return x.withColumn("_prev", F.coalesce(F.lag(category).over(Window.partitionBy(thread, "_stretch").orderBy("_pos")), "_carried")).drop("_carried"), [thread, "_stretch"], ["_pos"]


def _joined(x: DataFrame, by_stretch: DataFrame, thread: str) -> DataFrame:
    """The rows with what a table has of their stretch; a null thread is one as well."""
    more = [c for c in by_stretch.columns if c not in (thread, "_stretch")]
    same = F.col(f"x.{thread}").eqNullSafe(F.col(f"s.{thread}")) & (F.col("x._stretch") == F.col("s._stretch"))
    return x.alias("x").join(by_stretch.alias("s"), same).select("x.*", *[f"s.{c}" for c in more])


def shifts(df: DataFrame, thread: str, order: list[str], category: str, role: str, range_rows: int = numbering.RANGE_ROWS) -> DataFrame:
    """(thread, order, initiator_role, from_category, to_category) where the category changes; null categories don't count."""
    x, _, _ = _in_order(df, thread, order, category, range_rows)
    return x.where(F.col("_prev") != F.col(category)).select(thread, *order, F.col(role).alias("initiator_role"), F.col("_prev").alias("from_category"), F.col(category).alias("to_category"))


def runs(df: DataFrame, thread: str, order: list[str], category: str, role: str, range_rows: int = numbering.RANGE_ROWS) -> DataFrame:
    """(thread, run_id, category, initiator_role, start, end, n): maximal stretches of one category, by gaps and islands.

    Runs are numbered from 1 in their thread; where a thread is cut into stretches, its runs are numbered in
    each and moved on by the runs before, so a run over several stretches is one.
    """
    x, cut, within = _in_order(df, thread, order, category, range_rows)
    x = x.withColumn("_new", F.coalesce((F.col(category) != F.col("_prev")).cast("int"), F.lit(1)))
    x = x.withColumn("run_id", F.sum("_new").over(Window.partitionBy(*cut).orderBy(*within).rowsBetween(Window.unboundedPreceding, 0)))
    if len(cut) > 1:
        x = S.stored(x)
        began = x.groupBy(*cut).agg(F.sum("_new").alias("_runs"))
        before = Window.partitionBy(thread).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        moved = S.stored(began.select(*cut, F.coalesce(F.sum("_runs").over(before), F.lit(0)).alias("_before")))
        x = _joined(x, moved, thread).withColumn("run_id", F.col("run_id") + F.col("_before"))
    key = F.struct(*order)
    return x.groupBy(thread, "run_id").agg(F.min(category).alias("category"), F.min_by(role, key).alias("initiator_role"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count("*").alias("n"))


def sustained(found: DataFrame, least: int) -> DataFrame:
    return found.where(F.col("n") >= least)


def first_sustained(found: DataFrame, thread: str, least: int) -> DataFrame:
    """The earliest run of at least so many rows of each thread."""
    w = Window.partitionBy(thread).orderBy("start", "run_id")
    return sustained(found, least).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def count_windows(df: DataFrame, order: list[str], size: int, bucket_rows: int = numbering.RANGE_ROWS) -> DataFrame:
    """The rows with (window, place): tumbling windows of ``size`` rows in global order, an incomplete last one dropped.

    Rows are numbered by ranges of the order, so only counts pass through one task, however many rows a time has.
    """
    x = numbering.numbered(df, order, out="_at", total="_all", range_rows=bucket_rows).where(F.col("_at") < F.floor(F.col("_all") / size) * size)
    return x.withColumn("window", F.floor(F.col("_at") / size)).withColumn("place", F.col("_at") % size).drop("_all", "_at")


def deltas(df: DataFrame, order: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """First differences of columns over an ordered series, as delta_<column>."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    return df.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def states_quantile(df: DataFrame, x: str, y: str, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Adds state: both measures against their quantiles (linear interpolation); Transitional where neither rule holds or a value is null."""
    q = df.agg(*[F.percentile(c, F.lit(p)).alias(f"_{c}_{n}") for c in (x, y) for n, p in (("lo", low), ("hi", high))])
    s = df.crossJoin(F.broadcast(q))
    up = (F.col(x) >= F.col(f"_{x}_hi")) & (F.col(y) >= F.col(f"_{y}_hi"))
    down = (F.col(x) <= F.col(f"_{x}_lo")) & (F.col(y) <= F.col(f"_{y}_lo"))
    return s.withColumn("state", F.when(up, "Exploration").when(down, "Consolidation").otherwise("Transitional")).select(*df.columns, "state")


def states_rate(df: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """Adds deltas and state by the signs of both changes."""
    d = deltas(df, order, [x, y])
    dx, dy = F.col(f"delta_{x}"), F.col(f"delta_{y}")
    start = F.row_number().over(Window.orderBy(order)) == 1
    state = F.when(start, "Initial").when((dx > 0) & (dy > 0), "Exploration").when((dx < 0) & (dy < 0), "Consolidation").otherwise("Transitional")
    return d.withColumn("state", state)


def transitions(df: DataFrame, order: str, state: str = "state") -> DataFrame:
    """(from_state, to_state, n) of neighbouring rows."""
    x = df.withColumn("from_state", F.lag(state).over(Window.orderBy(order))).where(F.col("from_state").isNotNull())
    return x.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
