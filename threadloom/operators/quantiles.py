"""Exact quantiles, by linear interpolation, of groups of any size.

A group of few rows is sorted in one buffer.  In a larger one the ranks that a quantile needs are narrowed
down: a histogram between the bounds known so far says which bin has the rank, whose least and largest value
are the next bounds, until so few rows are between them that they may be sorted, or all are equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as S
from .numbering import numbered

#: Values that one buffer holds at most, bins of a histogram, and passes before the rest is sorted by ranges.
MOST, BINS, PASSES = 100_000, 1_024, 12


def _same(left: str, right: str, keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def _ranked(x: DataFrame, asked: DataFrame, keys: list[str], most: int, bins: int, passes: int) -> DataFrame:
    """(keys, rank, v): the values of the asked ranks (keys, rank, lo, hi) from 0, where lo and hi are the group's ends."""
    live = S.stored(asked.select(*keys, "rank", F.lit(0).cast("long").alias("below"), "lo", "hi", F.lit(most + 1).cast("long").alias("n")))
    done = live.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
    live = live.where("lo < hi")
    step = 0
    while live.limit(1).count():
        between = (F.col("x.v") >= F.col("s.lo")) & (F.col("x.v") <= F.col("s.hi"))
        # Ranks are a few for each group of over ``most`` rows, so their table is small beside the rows.
        met = x.alias("x").join(F.broadcast(live.alias("s")), _same("x", "s", keys) & between).select(*[F.col(f"s.{k}") for k in keys], "rank", "below", "lo", "hi", "n", "v")
        if step >= passes:
            here = numbered(met.select(*keys, "rank", "below", "v"), ["v"], within=(*keys, "rank"), out="at")
            return done.unionByName(here.where(F.col("at") + F.col("below") == F.col("rank")).select(*keys, "rank", "v"))
        few = met.where(F.col("n") <= most).groupBy(*keys, "rank").agg(F.array_sort(F.collect_list("v")).alias("all"), F.max("below").alias("below"))
        done = S.stored(done.unionByName(few.select(*keys, "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("v"))))
        part = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as a span may overflow
        hist = met.where(F.col("n") > most).groupBy(*keys, "rank", "below", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        live = S.stored(hist.select(*keys, "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi", "n"))
        done = S.stored(done.unionByName(live.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))))
        live = live.where("lo < hi")
        step += 1
    return done


def quantiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], most: int = MOST, bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """(keys, one column a quantile) of the values that aren't null, of every group that has one; null keys are a group.

    The values are stored once; no buffer holds more than ``most`` of them.
    """
    x = S.stored(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")))
    size = S.stored(x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    plain = lambda rows: rows.groupBy(*keys).agg(*[F.percentile("v", F.lit(p)).alias(name) for name, p in ps.items()])
    large = size.where(F.col("n") > most)
    if not large.limit(1).count():
        out = plain(x)
        return out if keys else out.where(F.coalesce(*[F.col(c) for c in ps]).isNotNull())
    names = [f"_k{i}" for i in range(len(keys))]
    hot = large.select(*[F.col(k).alias(c) for k, c in zip(keys, names, strict=True)])
    is_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, names, strict=True)], F.lit(True))
    places = {name: (F.col("n") - 1) * F.lit(p) for name, p in ps.items()}
    ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in places.values() for f in (F.floor, F.ceil)]))
    found = _ranked(x, large.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi"), keys, most, bins, passes)
    table = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    met = large.alias("g").join(table.alias("t"), _same("g", "t", keys)).select(*[F.col(f"g.{k}") for k in keys], "n", "at")
    low, high = (lambda h: F.element_at("at", F.floor(h).cast("long"))), (lambda h: F.element_at("at", F.ceil(h).cast("long")))
    exact = met.select(*keys, *[(low(h) + (high(h) - low(h)) * (h - F.floor(h))).alias(name) for name, h in places.items()])
    return exact.unionByName(plain(x.join(F.broadcast(hot), is_hot, "left_anti"))) if keys else exact
