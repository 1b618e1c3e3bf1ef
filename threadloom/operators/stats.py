"""Statistics: ranks, correlations, exact tests, lines, histograms, contrasts, and hash-ordered permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, column: str, keys: list[str], out: str) -> DataFrame:
    """Ranks from 1 in each key, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2)


def pearson(df: DataFrame, keys: list[str], x: str, y: str, min_std: float = 1e-12) -> DataFrame:
    """(keys, r, n) over rows with both values; null where a population deviation is under min_std."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    # Not corr(), which divides before a guard around it is looked at.
    r = F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))
    return d.groupBy(*keys).agg(F.when((sx >= min_std) & (sy >= min_std), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho, n): Pearson's r of average ranks."""
    d = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, keys, "_rx"), y, keys, "_ry")
    return pearson(d, keys, "_rx", "_ry").withColumnRenamed("r", "rho")


def correlation_pvalue(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs under Student's t, by the finite series for whole degrees of freedom; null for n < 3 or a null rho.

    With an angle of sine |rho|, the odd and even series run over powers of its cosine.
    """
    sine = F.least(F.abs(rho), F.lit(1.0))
    square = 1 - sine * sine
    odd = (n % 2) == 1  # n - 2 degrees of freedom are odd with n
    terms = F.greatest(F.floor((n - 2) / 2), F.lit(0)).cast("int")
    ratio = lambda i: F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))
    first = F.when(odd, F.sqrt(square)).otherwise(F.lit(1.0))
    start = F.struct(first.alias("t"), first.alias("s"))
    step = lambda a, i: F.struct((a["t"] * square * ratio(i)).alias("t"), (a["s"] + a["t"] * square * ratio(i)).alias("s"))
    more = F.when(terms > 1, F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.when(terms > 0, F.aggregate(more, start, step)["s"]).otherwise(F.lit(0.0))
    inside = F.when(odd, 2 / F.lit(math.pi) * (F.asin(sine) + sine * total)).otherwise(sine * total)
    return F.when((n >= 3) & rho.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))


def _let(f, **values: Column) -> Column:
    """f of values that are worked out once a row, however often f names them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0: Stirling's series eight steps up, where its error is below rounding, and back by the recurrence."""
    y = x + 8
    series = sum(F.lit(c) / F.pow(y, F.lit(float(e))) for c, e in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9), (-691 / 360360, 11)))
    steps = F.log(x) + sum(F.log(x + i) for i in range(1, 8))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def _stirling_error(n: Column) -> Column:
    """What ln n! has beyond (n + 1/2) ln n - n + ln(2 pi) / 2; 0 for n = 0, whose terms are left out where it is used."""
    large = sum(F.lit(c) / F.pow(n, F.lit(float(e))) for c, e in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7)))
    small = log_gamma(n + 1) - (n + 0.5) * F.log(n) + n - 0.5 * math.log(2 * math.pi)
    return F.when(n <= 0, 0.0).when(n < 30, small).otherwise(large)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x without the loss of digits near the mean."""
    v = (x - mean) / (x + mean)
    near = (x - mean) * v + 2 * x * v * sum(F.pow(v, F.lit(2.0 * j)) / (2 * j + 1) for j in range(1, 12))
    return F.when(x <= 0, mean).when(F.abs(v) < 0.1, near).otherwise(x * F.log(x / mean) + mean - x)


def log_binomial(k: Column, n: Column, p: float) -> Column:
    """ln of the probability of k hits in n, 0 < p < 1; the digits lost don't grow with n."""
    return _let(lambda v: _log_binomial(v["k"], v["n"], p), k=k.cast("double"), n=n.cast("double"))


def _log_binomial(k: Column, n: Column, p: float) -> Column:
    core = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    inner = 0.5 * (F.log(n) - F.log(k) - F.log(n - k) - math.log(2 * math.pi))
    return F.when(k <= 0, n * math.log1p(-p)).when(k >= n, n * math.log(p)).otherwise(core + inner)


def beta_fraction(a: Column, b: Column, x: float) -> Column:
    """The continued fraction of the incomplete beta function at x < (a + 1) / (a + b + 2), in as many steps as the root of a and b asks for."""
    return _let(lambda v: _beta_fraction(v["a"], v["b"], x), a=a, b=b)


def _beta_fraction(a: Column, b: Column, x: float) -> Column:
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    one = F.lit(1.0)
    steps = F.sequence(F.lit(1), (F.lit(60) + 6 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    d0 = 1 / safe(one - (a + b) * x / (a + 1))
    start = F.struct(one.alias("c"), d0.alias("d"), d0.alias("h"), F.lit(False).alias("end"))

    def turn(s: Column, coefficient: Column) -> tuple[Column, Column]:
        return safe(one + coefficient / s["c"]), 1 / safe(one + coefficient * s["d"])

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        c1, d1 = turn(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        half = F.struct(c1.alias("c"), d1.alias("d"), (s["h"] * c1 * d1).alias("h"))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def rest(t: Column) -> Column:
            c2, d2 = turn(t, odd)
            return F.struct(c2.alias("c"), d2.alias("d"), (t["h"] * c2 * d2).alias("h"), (F.abs(c2 * d2 - 1) < 1e-15).alias("end"))

        return F.when(s["end"], s).otherwise(_let(lambda v: rest(v["t"]), t=half))

    return F.aggregate(steps, start, step)["h"]


def binomial_two_sided(df: DataFrame, k: str, n: str, p: float = 0.5) -> DataFrame:
    """Adds p_value: the sum of the probabilities of all numbers of hits that are no likelier than the observed one; null for n = 0.

    Both tails are incomplete beta functions, and where the other tail begins is found by halving, so the work
    for a row grows with the root of n and its memory as little.  Likelihoods within 1e-7 of each other count as equal.
    """
    hits, all_ = F.col(k).cast("double"), F.col(n).cast("double")
    lower = lambda i: _let(lambda v: F.exp(_log_binomial(v["i"], v["n"], p)) * p * _beta_fraction(v["n"] - v["i"], v["i"] + 1, 1 - p), i=i, n=all_)  # noqa: E731  (at most i)
    upper = lambda i: _let(lambda v: F.exp(_log_binomial(v["i"], v["n"], p)) * (1 - p) * _beta_fraction(v["i"], v["n"] - v["i"] + 1, p), i=i, n=all_)  # noqa: E731  (at least i)
    x = df.withColumn("_l", log_binomial(hits, all_, p) + 1e-7).withColumn("_mode", F.least(F.floor((all_ + 1) * p).cast("double"), all_))
    # The first number of hits above the mode that is no likelier, or the last one below.
    ends = F.struct(F.when(hits < F.col("_mode"), F.col("_mode")).otherwise(F.lit(-1.0)).alias("lo"), F.when(hits < F.col("_mode"), all_ + 1).otherwise(F.col("_mode")).alias("hi"))
    above = hits < F.col("_mode")

    def halve(s: Column, l: Column, n: Column, above: Column) -> Column:  # noqa: E741
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("double")
        up = (log_binomial(mid, n, p) <= l) == above
        end = lambda v: F.struct(F.when(v["up"], s["lo"]).otherwise(v["mid"]).alias("lo"), F.when(v["up"], v["mid"]).otherwise(s["hi"]).alias("hi"))
        return F.when(s["hi"] - s["lo"] > 1, _let(end, up=up, mid=mid)).otherwise(s)

    bits = F.sequence(F.lit(1), (F.ceil(F.log2(all_ + 2)) + 1).cast("int"))
    found = _let(lambda v: F.aggregate(bits, v["ends"], lambda s, i: halve(s, v["l"], v["n"], v["above"])), ends=ends, l=F.col("_l"), n=all_, above=above)
    x = x.withColumn("_at", found)
    other = F.when(above, F.col("_at")["hi"]).otherwise(F.col("_at")["lo"])
    x = x.withColumn("_other", other).withColumn("_at_mode", log_binomial(F.col("_mode"), all_, p) <= F.col("_l"))
    low = F.when(above, hits).otherwise(F.col("_other"))
    high = F.when(above, F.col("_other")).otherwise(hits)
    tails = F.when(low >= 0, F.when(low >= all_, 1.0).otherwise(lower(low))).otherwise(0.0) + F.when(high <= all_, F.when(high <= 0, 1.0).otherwise(upper(high))).otherwise(0.0)
    value = F.when(all_ > 0, F.when(F.col("_at_mode"), 1.0).otherwise(F.least(tails, F.lit(1.0))))
    return x.withColumn("p_value", value).select(*df.columns, "p_value")


def line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept) of least squares."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """(bin, n) of equal bins from least to largest, the largest in the last bin."""
    lim = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.floor((F.col(x) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)) * bins)
    return df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(lim)).groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pick_windows(months: list[str], early: list[str], peak: list[str], late: list[str]) -> tuple[list[str], list[str], list[str]]:
    """The given windows where at least two, two and one of their months are there; else thirds of the months."""
    have = sorted(months)
    e, p, q = ([m for m in have if m in w] for w in (early, peak, late))
    if len(e) >= 2 and len(p) >= 2 and len(q) >= 1:
        return e, p, q
    one, two = max(1, len(have) // 3), max(2, 2 * len(have) // 3)
    return have[:one], have[one:two], have[two:]


def contrast(df: DataFrame, period: str, x: str, a: list[str], b: list[str]) -> Column:
    """Mean over the periods of a less the mean over those of b, as an aggregate."""
    return F.avg(F.when(F.col(period).isin(a), F.col(x))) - F.avg(F.when(F.col(period).isin(b), F.col(x)))


def permute(df: DataFrame, row_id: str, value: str, n: int, seed: int = 42, within: tuple[str, ...] = ()) -> DataFrame:
    """(perm_id, row columns, <value>_perm): n permutations of a value over rows, within groups if given.

    Values are dealt in the order of md5(perm_id|seed|row_id), which any engine repeats.  Rows are
    expanded by perm_id and never collected; each permutation is a partition of its own.
    """
    keys = ["perm_id", *within]
    x = df.crossJoin(df.sparkSession.range(n).select(F.col("id").alias("perm_id")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(row_id))
    shuffled = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", "perm_id", F.lit(str(seed)), row_id).cast("binary")), row_id))
    x = x.withColumns({"_at": place, "_to": shuffled})
    dealt = x.select(*keys, F.col("_to").alias("_at"), F.col(value).alias(f"{value}_perm"))
    return x.join(dealt, [*keys, "_at"]).drop("_at", "_to")


def perm_pvalue(nulls: DataFrame, stat: str, real: Column, alternative: str = "greater") -> Column:
    """Share of null statistics at least as extreme as the real one; nulls that are null don't count."""
    hit = {"greater": F.col(stat) >= real, "less": F.col(stat) <= real, "abs": F.abs(stat) >= F.abs(real)}[alternative]
    return F.avg(F.when(F.col(stat).isNotNull(), hit.cast("double")))
