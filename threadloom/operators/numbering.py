"""Numbers of rows in a global order, or in each group's order, however large a group is and however many rows are equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as S

#: Rows of one range; a range is sorted by one task, which may spill.
RANGE_ROWS = 250_000
#: A table of offsets of at most so many rows is broadcast.
BROADCAST_ROWS = 500_000
_LOW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], within: tuple[str, ...] = (), out: str = "pos", total: str | None = None, range_rows: int = RANGE_ROWS, parts: int | None = None) -> DataFrame:
    """The rows with their place from 0 in the order of ``order`` (nulls first), in each group of ``within`` if given, and their group's size as ``total``.

    Rows are dealt into ranges of (within, order), sorted there and written with their place in the range;
    the counts by range before a group's range are its offset.  A group is cut over as many ranges as it
    fills, and rows of one time by the columns after it, so no task holds a group; only counts by range meet.
    Rows that are equal in all of ``order`` are numbered in any order.  Null is a group like any other.
    """
    parts = parts or max(1, -(-df.count() // range_rows))
    by = [*within, *order]
    placed = S.stored(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit(_LOW))}).drop("_id")
    size = placed.groupBy(*within, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*within)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = S.stored(size.select(*within, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_all")))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}")) for c in within], F.col("x._part") == F.col("o._part"))
    few = offset.count() <= BROADCAST_ROWS
    out_cols = [*[F.col(f"x.{c}") for c in df.columns], (F.col("x._at") + F.col("o._shift")).alias(out), *([F.col("o._all").alias(total)] if total else [])]
    return placed.alias("x").join(F.broadcast(offset.alias("o")) if few else offset.alias("o"), same).select(*out_cols)


def running(df: DataFrame, order: list[str], within: tuple[str, ...], value: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with the sum of ``value`` up to and with each row, in the order of ``order`` in its group, and the next row's first order column as ``_next``.

    A table of one range's rows is summed group by group; a larger one is numbered first, so that a group's
    stretches are summed apart and a group of any size is spread over tasks.  ``order`` tells all rows apart.
    """
    rows = df.count()
    if rows <= range_rows:
        w = Window.partitionBy(*within).orderBy(*order)
        return df.withColumns({out: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead(order[0]).over(w)})
    x = numbered(df, order, within, out="_pos", range_rows=range_rows).withColumn("_stretch", F.expr(f"_pos div {range_rows}"))
    x = S.stored(x)
    sums = x.groupBy(*within, "_stretch").agg(F.sum(value).alias("_s"), F.min(order[0]).alias("_least"))
    group = Window.partitionBy(*within).orderBy("_stretch")
    before = S.stored(sums.select(*within, "_stretch", F.coalesce(F.sum("_s").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_least").over(group).alias("_after")))
    own = Window.partitionBy(*within, "_stretch").orderBy("_pos")
    x = x.withColumns({"_own": F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_lead": F.lead(order[0]).over(own)})
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in within], F.col("x._stretch") == F.col("b._stretch"))
    met = x.alias("x").join(before.alias("b"), same)
    return met.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("x._own") + F.col("b._before")).alias(out), F.coalesce("x._lead", "b._after").alias("_next"))
