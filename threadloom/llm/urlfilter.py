"""URL filters: rules by longest match, and a naive Bayes verdict over words that a unigram Viterbi pass finds in host names.

The tables hold no verdicts but the rules', so the pages that a rule decides are the labelled
examples.  Word counts for the segmentation come from the visible text of all pages.  Words and tokens
are counted without a bound and stay tables: what a host or a path needs of them is joined to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Tables of at most so many tokens, runs or hosts are broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 100_000


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path.  A url that is null or has no ``://`` has both empty; only A-Z of the host are lower-cased."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    known = url.contains("://")
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.when(known, host).otherwise("")).withColumn("path", F.when(known, path).otherwise(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and its path as a prefix.  Null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcasting where it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(w, n) of every word of all pages' visible text, as a stored table."""
    plain = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(plain), "[^a-z]+")).alias("w")).where(F.length("w") > 0)
    return B.stored(words.groupBy("w").agg(F.count("*").alias("n")), "url-words", B.bucket_count(pages))


def segment(label: str, costs: dict[str, float], unseen: float) -> list[str]:
    """The cheapest split of a label into words: Viterbi over end positions.

    A string outside the dictionary costs ``unseen`` and 4 nats a character more, so it's used only
    where known words can't cover the label.  Ties take the shorter last word.
    """
    n = len(label)
    lengths = sorted({len(w) for w in costs})
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    start = 0  # where the best unknown last word begins
    for e in range(1, n + 1):
        if best[e - 1] - 4.0 * (e - 1) <= best[start] - 4.0 * start:
            start = e - 1
        c, s = best[start] + unseen + 4.0 * (e - start), start
        for k in lengths:
            if k > e:
                break
            w = label[e - k : e]
            if w in costs and (best[e - k] + costs[w], k) < (c, e - s):
                c, s = best[e - k] + costs[w], e - k
        best[e], back[e] = c, s
    out, e = [], n
    while e:
        out.append(label[back[e] : e])
        e = back[e]
    return out[::-1]


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, tokens) of a stored table of distinct hosts: each label, cut at non-letters, segmented by the counts of the words in it."""
    told = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.sort_array(F.collect_set(F.length("w"))).alias("lengths")).first()
    total, lengths = told["total"], told["lengths"]
    unseen = (-math.log(told["least"] / total) if total else 10.0) + 2.0
    parts = hosts.select("host", F.posexplode(F.filter(F.split("host", "[^a-z]+"), lambda r: r != "")).alias("pos", "run"))
    runs = B.stored(parts.select("run").distinct(), "url-runs", B.bucket_count(hosts))

    def substrings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[str, str]] = []
        for x in frames:
            for run in x["run"]:
                for k in lengths:
                    if k > len(run):
                        break
                    rows += [(run, w) for w in {run[i : i + k] for i in range(len(run) - k + 1)}]
                    if len(rows) > 10_000:
                        yield pd.DataFrame(rows, columns=["run", "w"])
                        rows = []
        yield pd.DataFrame(rows, columns=["run", "w"])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            words = [segment(run, {} if k is None else {r["w"]: -math.log(r["n"] / total) for r in k}, unseen) for run, k in zip(x["run"], x["known"], strict=True)]
            yield pd.DataFrame({"run": x["run"], "words": words})

    known = runs.mapInPandas(substrings, "run string, w string").join(counts, "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    words = B.stored(runs.join(known, "run", "left").mapInPandas(split, "run string, words array<string>"), "url-segments", B.bucket_count(hosts))
    found = parts.join(small(words), "run").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda p: p["words"])).alias("words"))
    return B.stored(found.select("host", F.transform("words", lambda w: F.concat(F.lit("h:"), w)).alias("tokens")), "url-hosts", B.bucket_count(hosts))


def path_tokens(path: str) -> list[str]:
    """Tokens of a path; digits count by their number of places."""
    pieces = path.lower().replace(".", "/").replace("-", "/").replace("_", "/").split("/")
    return ["p:" + (f"#{len(p)}" if p.isdigit() else p) for p in pieces if p]


def with_path_tokens(paths: DataFrame) -> DataFrame:
    """(path, tokens) of distinct paths, as a stored table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"path": x["path"], "tokens": [path_tokens(p) for p in x["path"]]})

    return B.stored(paths.mapInPandas(run, "path string, tokens array<string>"), "url-paths", B.bucket_count(paths))


def fit(labelled: DataFrame, hosts: DataFrame, paths: DataFrame, alpha: float = 1.0) -> tuple[float, DataFrame, float]:
    """Multinomial naive Bayes from (host, path, verdict): (bias, stored table (token, weight) of every token, weight of an unseen one)."""
    base = labelled.groupBy("host", "path", "verdict").agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")]
    # Equal hosts and equal paths are summed before they meet their tokens.
    told = [base.groupBy(k).agg(*sums).join(tokens, k).select("allow", "block", F.explode("tokens").alias("token")) for k, tokens in (("host", hosts), ("path", paths))]
    counts = B.stored(told[0].unionByName(told[1]).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-tokens", B.bucket_count(labelled))
    all_ = counts.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("allow", "block")]).first()
    prior = {r["verdict"]: r["n"] for r in base.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    total = {v: all_[v] + alpha * (all_["n"] + 1) for v in ("allow", "block")}
    n = sum(prior.values())
    bias = math.log((prior.get("block", 0) + 1) / (n + 2)) - math.log((prior.get("allow", 0) + 1) / (n + 2))
    weight = F.log((F.col("block") + alpha) / total["block"]) - F.log((F.col("allow") + alpha) / total["allow"])
    return bias, counts.select("token", weight.alias("weight")), math.log(alpha / total["block"]) - math.log(alpha / total["allow"])


def token_sums(tokens: DataFrame, key: str, weights: DataFrame, unseen: float, name: str) -> DataFrame:
    """(key, name): the summed weights of each row's tokens, in their order, as a stored table."""
    each = tokens.select(key, F.posexplode("tokens").alias("pos", "token")).join(weights, "token", "left")
    own = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("weight", F.lit(unseen)).alias("weight"))))
    return B.stored(each.groupBy(key).agg(F.aggregate(own, F.lit(0.0), lambda a, t: a + t["weight"]).alias(name)), "url-" + name, B.bucket_count(tokens))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_log_odds) of every page.

    The rule's verdict holds where one fits; else naive Bayes decides, block where the log odds are over 0
    (a tie allows).  With no labelled page at all every undecided page is allowed.  Null urls have empty
    host and path and are judged by the prior.  Repeated rows stay.
    """
    base = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = base.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    ruled = B.stored(ruled, "url-pages", B.bucket_count(pages))
    hosts = host_tokens(B.stored(ruled.select("host").distinct(), "url-names", B.bucket_count(ruled)), word_counts(base))
    paths = with_path_tokens(ruled.select("path").distinct())
    bias, weights, unseen = fit(ruled.where(F.col("said").isNotNull()).select("host", "path", F.col("said").alias("verdict")), hosts, paths)
    weights = small(weights)
    of_host, of_path = token_sums(hosts, "host", weights, unseen, "host_odds"), token_sums(paths, "path", weights, unseen, "path_odds")
    odds = F.lit(bias) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    scored = ruled.join(small(of_host), "host", "left").join(small(of_path), "path", "left").withColumn("block_log_odds", odds)
    verdict = F.coalesce("said", F.when(F.col("block_log_odds") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_log_odds")
