"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ten words, each a set of positional three-word shingles.  A
document holds a window only if it holds its rarest shingle, so that one shingle (the prefix that
full containment needs) joins the documents; rarity is counted over all documents.  The shingle's
place in the window gives where the window would begin, the document's length bounds it, and the
words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

WINDOW, SHINGLE = 10, 3
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of a benchmark up to which its side is broadcast; a larger one is joined by a shuffle on the shingle.
BROADCAST_WINDOWS = 100_000


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then runs of letters, digits and all beyond ASCII; null has none."""
    full = F.coalesce(text, F.lit(""))
    # lower() agrees with A-Z for pure ASCII and is the fast way there.
    low = F.when(F.octet_length(full) == F.char_length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOW))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, win, seq, off, h): the shingles of every distinct window of every item.

    ``seq`` are the window's words.  An item of fewer words than a window, but not none, is one
    window; one of fewer words than a shingle has its words as a shorter shingle.
    """
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    first = F.greatest(F.size("w") - window, F.lit(0))
    seqs = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), first), lambda i: F.slice(F.col("w"), i + 1, window))).alias("seq")).distinct()
    size = F.least(F.size("seq"), F.lit(shingle))
    offs = seqs.select("item_id", "seq", size.alias("k"), F.explode(F.sequence(F.lit(0), F.size("seq") - size)).alias("off"))
    return offs.withColumn("h", _hash_at(F.col("seq"), F.col("off"), F.col("k"), shingle))


def _hash_at(seq: Column, at: Column, k: Column, shingle: int) -> Column:
    """Hash of the k <= shingle words from ``at`` (zero-based) on; a shorter shingle's hash has its own salt."""
    return F.coalesce(*[F.when(k == n, shingle_hash(seq, at, n)) for n in range(1, shingle + 1)])


def shingle_hash(seq: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(seq, at + j) for j in range(k)])


def _exploded(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, tkey, w, n, pos, h): a row for each shingle of these sizes of each document, from one pass over its words."""
    d = docs.select("doc_id", "tkey", words(F.col("text")).alias("w"))
    rows = d.select("doc_id", "tkey", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    hashes = [F.when(F.col("pos") + k <= F.col("n"), shingle_hash(F.col("w"), F.col("pos"), k)) for k in sizes]
    if len(sizes) == 1:
        return rows.select("doc_id", "tkey", "w", "n", "pos", hashes[0].alias("h")).where("h is not null")
    return rows.select("doc_id", "tkey", "w", "n", "pos", F.explode(F.array(*hashes)).alias("h")).where("h is not null")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, tkey, start, length, items): every place of a document (doc_id, text, tkey) where a window of these items begins.

    A larger benchmark than ``broadcast_windows`` windows is joined by a shuffle, which sends the words
    around a shingle and not the document; a shingle of very many places is split by Spark, as its
    benchmark side is small.
    """
    shingles = B.stored(windows(items, window, shingle), "bench-windows", B.bucket_count(items))
    stat = shingles.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("k")).alias("k")).first()
    small = stat["n"] <= broadcast_windows * window
    hint = F.broadcast if small else (lambda d: d)
    rows = _exploded(docs, stat["k"] or [shingle])
    # Rarity of the benchmark's shingles over all documents.
    counts = rows.select("h").join(hint(shingles.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("df"))
    rank = Window.partitionBy("item_id", "seq").orderBy(F.coalesce(F.col("df"), F.lit(0)), "h", "off")
    prefix = shingles.join(counts, "h", "left").withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    # A window whose rarest shingle no document has can't occur.
    prefix = B.stored(prefix.where("df > 0").groupBy("h", "seq", "off").agg(F.collect_set("item_id").alias("items")), "bench-prefix", B.bucket_count(items))
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.size("seq") <= F.col("n"))
    if small:
        met = rows.join(F.broadcast(prefix), "h").where(inside & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("seq")) == F.col("seq")))
    else:
        base = F.greatest(F.col("pos") - window, F.lit(0))
        near = rows.select("doc_id", "tkey", "n", "pos", "h", base.alias("base"), F.slice("w", base + 1, 2 * window).alias("w"))
        met = near.join(prefix, "h").where(inside & (F.slice("w", F.greatest(start - F.col("base"), F.lit(0)) + 1, F.size("seq")) == F.col("seq")))
    return met.select("doc_id", "tkey", start.alias("start"), F.size("seq").alias("length"), "items")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: the words hit as an array of (first, end), and the sorted items whose windows occur.

    Null or empty texts have no words and no hits, an empty benchmark hits nothing.  Rows come out once each
    and are judged by their own texts, whatever their ids: repeated rows, repeated ids and null ids too.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("tkey"))
    found = hits(src, items, window, shingle)
    by_doc = found.groupBy("doc_id", "tkey").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Spans of the union: hits in order that touch are one; the open one goes to the spans when the next begins behind it.
    none = F.array().cast("array<struct<first:int,end:int>>")
    span = lambda first, end: F.array(F.struct(first.alias("first"), end.alias("end")))
    empty = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("end"), none.alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        on = x["start"] <= acc["end"]
        first, end = F.when(on, acc["first"]).otherwise(x["start"]), F.when(on, F.greatest(acc["end"], x["end"])).otherwise(x["end"])
        spans = F.when(on | (acc["end"] < 0), acc["spans"]).otherwise(F.concat(acc["spans"], span(acc["first"], acc["end"])))
        return F.struct(first.alias("first"), end.alias("end"), spans.alias("spans"))

    def close(acc: Column) -> Column:
        return F.when(acc["end"] < 0, none).otherwise(F.concat(acc["spans"], span(acc["first"], acc["end"])))

    hit = B.stored(by_doc.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), F.aggregate("hit", empty, add, close).alias("spans"), "items"), "bench-hits", B.bucket_count(src, 64 << 20))
    counted = src.select("doc_id", "tkey", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    full = counted.join(F.broadcast(hit) if B.input_bytes(hit) <= B.BROADCAST_BYTES else hit, counted["doc_id"].eqNullSafe(hit["_id"]) & (counted["tkey"] == hit["_key"]), "left")
    return full.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
