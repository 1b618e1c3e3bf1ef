"""Quality rules: base statistics of a text, and lines that too many documents of a host share.

Each text is read once, in numpy over whole Arrow batches; what goes on are statistics and a hash for each
line.  Distinct texts of a host are counted by line, lines over the host's limit are removed, and a
document of which too little is left is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Words of a repeated window.
WINDOW = 8
#: A document fails with fewer words, or with a larger share of words in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line is removed that over so many different texts of a host have, and over such a share of them.
LEAST_TEXTS, SHARE = 10, 0.02
#: A document is rejected of whose words a larger share, in hundredths, stands in removed lines.
MOST_REMOVED = 50
SYMBOLS = b"#*$%&|<>"

#: Lower case, and every digit as 0, so that counters and dates don't tell lines apart.
NORMAL = B.LOWER.copy()
NORMAL[48:58] = 48
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SALT = np.uint64(0x9E3779B97F4A7C15)

LINE = pa.struct([("h", pa.int64()), ("words", pa.int32()), ("at", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_key", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("lines", pa.list_(LINE))])
BASE = "doc_id long, host string, text_key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_doc(hit: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of a flag between cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[cut])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measure(data: np.ndarray, offs: np.ndarray) -> dict:
    """Statistics of each document of a block, and its lines that have a word, in order: normalised hash, words, number of the line."""
    docs = len(offs) - 1
    starts, ends, first = B.word_spans(B.SPACE[data], offs)
    owner = B.owners(first)
    words = np.diff(first)
    symbols = _per_doc(_SYMBOL[data], offs)
    chars = _per_doc(~B.SPACE[data] & ((data & 0xC0) != 0x80), offs)
    by_doc = B.mix(owner.astype(np.uint64) + _SALT)
    # Windows found twice or more in a text: the words that any of them covers.
    grams = B.gram_hashes(B.word_hashes(data, starts, ends), WINDOW)
    inside = np.arange(len(grams)) + WINDOW <= first[owner[: len(grams)] + 1]
    at = np.flatnonzero(inside)
    at = at[_repeated(grams[at] ^ by_doc[at])]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + WINDOW, len(starts)), -1)
    repeat = _per_doc(np.cumsum(cover[:-1]) > 0, first)
    # Lines: a word's line is told by the line breaks and the documents before it.
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, starts)
    begun = np.flatnonzero(np.diff(number + owner, prepend=-1))
    doc = owner[begun]
    lo = np.maximum(np.where(number[begun] > 0, breaks[number[begun] - 1] + 1, 0) if len(breaks) else 0, offs[doc])
    hi = np.minimum(np.append(breaks, len(data))[number[begun]], offs[doc + 1])
    raw = B.word_hashes(data, lo, hi) ^ by_doc[begun]
    order = np.argsort(raw, kind="stable")
    again = np.zeros(len(raw), bool)
    again[order[1:]] = raw[order[1:]] == raw[order[:-1]]
    line_cut = np.searchsorted(begun, first)
    size = np.diff(np.append(begun, len(starts)))
    place = np.arange(len(starts)) - np.repeat(begun, size)
    own = B.mix(B.word_hashes(NORMAL[data], starts, ends) + place.astype(np.uint64) * _SALT)
    lines = B.mix(np.add.reduceat(own, begun)) if len(begun) else np.zeros(0, np.uint64)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": _per_doc(again, line_cut), "n_repeat_words": repeat, "docs": docs, "cut": line_cut, "h": lines.view(np.int64), "words": size, "at": number[begun] - np.searchsorted(breaks, offs[doc])}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, n, data, offs in B.text_blocks(batch):
            m = measure(data, offs)
            flat = pa.StructArray.from_arrays([pa.array(m["h"]), pa.array(m["words"].astype(np.int32)), pa.array(m["at"].astype(np.int32))], fields=list(LINE))
            lines = pa.ListArray.from_arrays(pa.array(m["cut"].astype(np.int32)), flat).cast(pa.list_(LINE))
            part = batch.slice(a, n)
            cols = [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), part.column(2).cast(pa.string())]
            stats = [pa.array(m[c]).cast(pa.int64()) for c in SCHEMA.names[3:8]]
            yield pa.RecordBatch.from_arrays([*cols, *stats, lines], schema=SCHEMA)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """A stored row for each document: (row, doc_id, host, text_key, the base statistics, lines)."""
    key = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("host"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")
    out = rows.mapInArrow(B.tidy(_measured), f"{BASE}, lines array<struct<h:long,words:int,at:int>>")
    return B.stored(out.withColumn("row", F.monotonically_increasing_id()), "line-rows")


def frequent_lines(rows: DataFrame, least: int = LEAST_TEXTS, share: float = SHARE) -> DataFrame:
    """(host, h, texts, n): lines that over ``least`` different texts of a host have and over a ``share`` of them; n rows have the line.

    Equal texts count once, so copies of a document don't make its lines frequent; they are combined
    before the shuffle.
    """
    hashes = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    texts = rows.select("host", "text_key", hashes.alias("hs")).groupBy("host", "text_key").agg(F.first("hs").alias("hs"), F.count("*").alias("copies"))
    texts = B.stored(texts, "line-texts")
    lines = texts.select("host", "copies", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("texts"), F.sum("copies").alias("n")).where(F.col("texts") > least)
    # A host whose share is no more than the least has that limit, so only larger ones are joined.
    hosts = texts.groupBy("host").agg(F.count("*").alias("_all")).where(F.col("_all") * share > least)
    few = hosts.count() <= B.BROADCAST_ROWS
    limit = F.greatest(F.lit(float(least)), F.coalesce(F.col("_all") * share, F.lit(0.0)))
    return B.stored(lines.join(F.broadcast(hosts) if few else hosts, "host", "left").where(F.col("texts") > limit).drop("_all"), "line-frequent")


def _removed(rows: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """(row, n_removed_words, removed): the numbers of the removed lines and the words in them.

    The frequent lines that over a ``most``-th of all lines are, of which there are at most ``most``, are
    broadcast; a line that is none of them is rare enough to be joined by a shuffle.
    """
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.words", "x.at")
    hits = [lines.join(F.broadcast(frequent), ["host", "h"])]
    if frequent.count() > most:
        bound = rows.agg(F.sum(F.size("lines")).alias("n")).first()["n"] / most
        hits = [lines.join(F.broadcast(frequent.where(F.col("n") > bound)), ["host", "h"]), lines.join(frequent.where(F.col("n") <= bound), ["host", "h"])]
    found = reduce(DataFrame.unionByName, [h.select("row", "words", "at") for h in hits])
    return found.groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.array_sort(F.collect_list("at")).alias("removed"))


def judge(docs: DataFrame, host: str = "source", least: int = LEAST_TEXTS, share: float = SHARE, most_removed: int = MOST_REMOVED, most_broadcast: int = B.BROADCAST_ROWS) -> DataFrame:
    """(doc_id, host, text_key, statistics, base_failed, n_removed_words, removed, kept) of each row.

    ``host`` is the column whose values have lines of their own; a null one is a host as well.  ``removed``
    numbers the lines (split at line breaks, from 0) that are cut from the text.  A row is kept that didn't
    fail the base rules, has LEAST_WORDS left and lost no more than ``most_removed`` hundredths of its words.
    A null text is empty and fails.  Rows with a null or repeated id are judged by themselves; equal rows
    get equal verdicts.  Lines are told apart by 64-bit hashes.
    """
    rows = measured(docs, host)
    lost = _removed(rows, frequent_lines(rows, least, share), most_broadcast)
    x = rows.drop("lines").join(lost, "row", "left").drop("row").withColumns({"n_removed_words": F.coalesce("n_removed_words", F.lit(0)).cast("long"), "removed": F.coalesce("removed", F.array().cast("array<int>"))})
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    left = (F.col("n_words") - F.col("n_removed_words") >= LEAST_WORDS) & (F.col("n_removed_words") * 100 <= F.col("n_words") * most_removed)
    return x.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def cleaned(docs: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, the removed lines cut from their texts; all columns stay, and so do repeated rows."""
    one = verdicts.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_key").alias("_key")).agg(F.first("removed").alias("_removed"))
    x = docs.withColumns({"_h": F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-")), "_k": F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    x = x.join(one, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_host")) & (F.col("_k") == F.col("_key")))
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_removed", i)), "\n")
    return x.withColumn("text", F.when(F.size("_removed") > 0, rest).otherwise(F.col("text"))).select(*docs.columns)
