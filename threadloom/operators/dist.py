"""Distributions over categories: shares, entropy, divergence, similarity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as S


def counts(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, category, n)."""
    return df.groupBy(*keys, category).agg(F.count("*").alias("n"))


def shares(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, category, n, share): the share of each category that is present, over counts and not over rows."""
    return counts(df, keys, category).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def two_sided(df: DataFrame, keys: list[str], category: str, side: str, left: str, right: str) -> DataFrame:
    """(keys, category, l, r): counts of both sides by one conditional aggregation."""
    return df.where(F.col(side).isin(left, right)).groupBy(*keys, category).agg(F.count_if(F.col(side) == left).alias("l"), F.count_if(F.col(side) == right).alias("r"))


def side_counts(df: DataFrame, period: str, category: str, side: str, left: str, right: str, least: int = 0) -> DataFrame:
    """(period, category, l, r) stored, so that all that is made of the counts reads the rows once; with ``least``, of the periods in which each side has so many rows."""
    c = S.stored(two_sided(df, [period], category, side, left, right))
    if not least:
        return c
    full = c.groupBy(period).agg(F.sum("l").alias("_l"), F.sum("r").alias("_r")).where((F.col("_l") >= least) & (F.col("_r") >= least))
    return S.stored(c.join(F.broadcast(full.select(period)), period, "left_semi"))


def scaffolded(df: DataFrame, period: str, category: str, side: str, left: str, right: str) -> DataFrame:
    """(period, category, left_share, right_share) with a row for every period and category, 0 where there is none; the rows are read once."""
    return scaffold(side_counts(df, period, category, side, left, right), period, category)


def scaffold(c: DataFrame, period: str, category: str) -> DataFrame:
    """The same of counts (period, category, l, r).

    The scaffold is made of distinct periods and categories, both of which are few.
    """
    grid = c.select(period).distinct().crossJoin(F.broadcast(c.select(category).distinct()))
    w = Window.partitionBy(period)
    full = grid.join(c, [period, category], "left").select(period, category, F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    part = lambda x: F.coalesce(F.col(x) / F.nullif(F.sum(x).over(w), F.lit(0)), F.lit(0.0))
    return full.select(period, category, part("l").alias("left_share"), part("r").alias("right_share"))


def entropy(df: DataFrame, keys: list[str], category: str, base: float | None = None, exclude: tuple = ()) -> DataFrame:
    """(keys, n, categories, entropy) of the categories present, natural logarithm unless a base is given; excluded ones don't count."""
    kept = df.where(~F.col(category).isin(*exclude)) if exclude else df
    s = shares(kept, keys, category)
    total = F.sum(-F.col("share") * F.log("share"))
    return s.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("categories"), (total / F.lit(math.log(base)) if base else total).alias("entropy"))


def _js(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return (term(p) + term(q)) / 2


def js_distance(df: DataFrame, keys: list[str], category: str, side: str, left: str, right: str, min_support: int = 10) -> DataFrame:
    """(keys, left_n, right_n, js_distance): the square root of the Jensen-Shannon divergence (natural logarithm) of two sides.

    Null where a side has fewer than ``min_support`` rows.
    """
    w = Window.partitionBy(*keys)
    c = two_sided(df, keys, category, side, left, right).withColumns({"l_all": F.sum("l").over(w), "r_all": F.sum("r").over(w)})
    js = F.sum(_js(F.col("l") / F.nullif(F.col("l_all"), F.lit(0)), F.col("r") / F.nullif(F.col("r_all"), F.lit(0))))
    out = c.groupBy(*keys).agg(F.max("l_all").alias("left_n"), F.max("r_all").alias("right_n"), js.alias("d"))
    ok = (F.col("left_n") >= min_support) & (F.col("right_n") >= min_support)
    return out.select(*keys, "left_n", "right_n", F.when(ok, F.sqrt(F.greatest("d", F.lit(0.0)))).alias("js_distance"))


def js_from_reference(dist: DataFrame, period: str, category: str, train: Column, eps: float = 1e-10, base: float = 2.0) -> DataFrame:
    """(period, jsd): distance of each period's shares from the mean shares of the training periods, smoothed by eps and renormalized.

    ``dist`` has a row for every period and category.
    """
    w = Window.partitionBy(period)
    ref = dist.where(train).groupBy(category).agg(F.avg("share").alias("ref"))
    x = dist.join(F.broadcast(ref), category).withColumns({"p": F.col("share") + eps, "q": F.col("ref") + eps})
    x = x.withColumns({"p": F.col("p") / F.sum("p").over(w), "q": F.col("q") / F.sum("q").over(w)})
    return x.groupBy(period).agg(F.sqrt(F.greatest(F.sum(_js(F.col("p"), F.col("q"))), F.lit(0.0)) / math.log(base)).alias("jsd"))


def curves(df: DataFrame, period: str, role: str, category: str, left: str = "user", right: str = "assistant", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, period, user_msgs, assistant_msgs, entropy_user, js_distance) by one aggregation of the rows."""
    return curves_of_counts(two_sided(df, [*keys, period], category, role, left, right), [*keys, period])


def curves_of_counts(c: DataFrame, by: list[str]) -> DataFrame:
    """The curves of counts ``l`` and ``r`` of both sides by (by, category)."""
    w = Window.partitionBy(*by)
    c = c.withColumns({"l_all": F.sum("l").over(w), "r_all": F.sum("r").over(w)})
    p, q = F.col("l") / F.nullif(F.col("l_all"), F.lit(0)), F.col("r") / F.nullif(F.col("r_all"), F.lit(0))
    out = c.groupBy(*by).agg(F.max("l_all").alias("user_msgs"), F.max("r_all").alias("assistant_msgs"), F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy_user"), F.sum(_js(p, q)).alias("d"))
    ok = (F.col("user_msgs") >= 10) & (F.col("assistant_msgs") >= 10)
    return out.select(*by, "user_msgs", "assistant_msgs", "entropy_user", F.when(ok, F.sqrt(F.greatest("d", F.lit(0.0)))).alias("js_distance"))


def cosines(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], eps: float = 1e-12) -> DataFrame:
    """(keys, one column a pair): name -> the cosine of two vectors in long form, all by one aggregation; null where a norm is under eps."""

    def one(x: str, y: str) -> Column:
        nx, ny = F.sqrt(F.sum(F.col(x) * F.col(x))), F.sqrt(F.sum(F.col(y) * F.col(y)))
        return F.when((nx >= eps) & (ny >= eps), F.sum(F.col(x) * F.col(y)) / F.nullif(nx * ny, F.lit(0.0)))

    return df.groupBy(*keys).agg(*[one(x, y).alias(name) for name, (x, y) in pairs.items()])


def cosine(df: DataFrame, keys: list[str], x: str, y: str, eps: float = 1e-12) -> DataFrame:
    """(keys, cosine) of two vectors in long form; null where a norm is under eps."""
    return cosines(df, keys, {"cosine": (x, y)}, eps)


def qualifying(df: DataFrame, period: str, role: str, least: int, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Rows of the periods in which each role has at least so many rows."""
    n = df.groupBy(period).agg(*[F.count_if(F.col(role) == r).alias(f"_{r}") for r in roles])
    return df.join(n.where(reduce(lambda a, b: a & b, [F.col(f"_{r}") >= least for r in roles])).select(period), period, "left_semi")
