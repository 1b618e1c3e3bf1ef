"""Quality classifier: document statistics, random Fourier features of a Gaussian kernel, ridge scores, isotonic calibration.

Texts are read once: the statistics of every document are written as a narrow table.  The normal
equations are sums over partitions, added up by Spark; what reaches the driver is one D x D matrix
and the calibration's bins, whatever the number of labels.  Isotonic means are those of BINS bins of raw
scores between -0.5 and 1.5, not of single scores; between the bins' mean scores the value is interpolated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

STATS = ["log_bytes", "upper", "lower", "digit", "space", "stop_mark", "symbol", "high", "log_words", "word_len", "word_len_sd", "long_words", "capital_words", "distinct_words", "same_as_last", "top_word", "distinct_pairs", "log_lines", "line_len", "repeated_lines", "closed_lines"]
FEATURES, RIDGE, SEED, BINS = 256, 1e-3, 20240, 1024

_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[B.SPACE] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_CLOSED = np.zeros(256, bool)
_CLOSED[[ord(c) for c in ".!?:\""]] = True


def _repeats(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the most frequent) of each document."""
    n = len(first) - 1
    doc = B.owners(first)
    order = np.lexsort((keys, doc)) if len(keys) else np.zeros(0, np.int64)
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], count)
    return np.bincount(d[at], minlength=n), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The statistics of each document, [documents, len(STATS)]; shares of nothing are 0."""
    n = len(offs) - 1
    size = np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount((doc << 3) | _CLASS[data], minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]
    starts, ends, first = B.word_spans(B.SPACE[data], offs)
    words = np.diff(first)
    w = np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    owner = B.owners(first)
    total = lambda x, own=owner: np.bincount(own, x, n)
    mean = total(length) / w
    h = B.word_hashes(B.LOWER[data], starts, ends)
    kind, most = _repeats(h, first)
    inside = np.ones(len(h), bool)
    inside[first[:-1][words > 0]] = False
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    pair = B.gram_hashes(h, 2)
    ok = inside[1:] if len(h) else np.zeros(0, bool)
    pair_first = np.searchsorted(np.flatnonzero(ok), first)
    pair_kind, _ = _repeats(pair[ok], pair_first)
    lstarts, lends, lfirst = B.word_spans(_NEWLINE[data], offs)
    lines = np.diff(lfirst)
    lw = np.maximum(lines, 1)
    # A line's hash: the sum of its words' mixed hashes in order, by way of running sums.
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(h + np.uint64(1)), dtype=np.uint64)])
    lh = run[np.searchsorted(starts, lends)] - run[np.searchsorted(starts, lstarts)]
    line_kind, _ = _repeats(lh, lfirst)
    out = [
        np.log1p(size), *kinds[:, 1:8].T, np.log1p(words), mean, np.sqrt(np.maximum(total(length**2) / w - mean**2, 0)), total(length > 15) / w,
        total(_CLASS[data[starts]] == 1) / w, kind / w, total(same * inside) / w, most / w, pair_kind / np.maximum(words - 1, 1),
        np.log1p(lines), np.log1p(size / lw), (lines - line_kind) / lw, np.bincount(B.owners(lfirst), _CLOSED[data[lends - 1]], n) / lw,
    ]
    return np.stack(out, 1)


def document_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics): one row a document, written to the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), *((s, pa.float64()) for s in STATS)])

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, data, offs in B.text_blocks(batch):
                x = statistics(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], schema=schema)

    kind = ", ".join(["doc_id long", *(f"{s} double" for s in STATS)])
    return B.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind), "quality-stats", B.bucket_count(docs))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    edges: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features: cosines whose products approximate the Gaussian kernel; one constant more."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turn + self.phase), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.edges, self.value), 0, 1)


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns], 1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of ordered groups, pooled until they don't fall (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for s, k in zip(y, n, strict=True):
        blocks.append([float(s), float(k), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, k2, c2 = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += k2
            blocks[-1][2] += c2
    return np.concatenate([np.full(int(c), s / k) for s, k, c in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """A model from all rows of ``labels`` (doc_id, quality) that have statistics; None without any.

    Several labels of a document count as their largest.  Labels join the narrow table, never the texts.
    Rows that share an id, equal ones too, are each learnt from with its label; a row without id has none.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = stats.join(known, "doc_id").select("y", *STATS)
    first = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(s).alias(f"m_{s}") for s in STATS], *[F.stddev_pop(s).alias(f"s_{s}") for s in STATS]).first()
    if not first["n"]:
        return None
    rng = np.random.default_rng(seed)
    d = len(STATS)
    model = Model(np.array([first[f"m_{s}"] for s in STATS]), np.maximum([first[f"s_{s}"] for s in STATS], 1e-6), rng.normal(size=(d, features)) / np.sqrt(d / 2), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))
    sent = stats.sparkSession.sparkContext.broadcast(model)
    width = features + 2

    @B.tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, m = np.zeros((width, width)), sent.value
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                z = np.concatenate([m.features(_matrix(batch, STATS)), batch.column(0).to_numpy(zero_copy_only=False)[:, None]], 1)
                a += z.T @ z
        if some:
            yield B.row_batch(pa.schema([("i", pa.int32()), ("blob", pa.binary())]), i=np.arange(width), blob=[r.tobytes() for r in a])

    @B.tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(blob)
        yield B.row_batch(pa.schema([("i", pa.int32()), ("blob", pa.binary())]), i=list(total), blob=[x.tobytes() for x in total.values()])

    spark = stats.sparkSession
    parts = rows.mapInArrow(sums, "i int, blob binary").repartition(min(B.partitions(spark), width), "i").mapInArrow(add, "i int, blob binary").collect()
    a = np.zeros((width, width))
    for r in parts:
        a[r["i"]] = np.frombuffer(bytes(r["blob"]))
    k = features + 1
    penalty = np.eye(k) * ridge * first["n"] / features
    penalty[-1, -1] = 1e-9
    model.weight = np.linalg.solve(a[:k, :k] + penalty, a[:k, k])
    sent2 = spark.sparkContext.broadcast(model)

    @B.tidy
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, n, s = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                raw = sent2.value.raw(_matrix(batch, STATS))
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                y += np.bincount(at, batch.column(0).to_numpy(zero_copy_only=False), BINS)
                s += np.bincount(at, raw, BINS)
                n += np.bincount(at, minlength=BINS)
        at = np.flatnonzero(n)
        yield B.row_batch(pa.schema([("bin", pa.int32()), ("y", pa.float64()), ("s", pa.float64()), ("n", pa.float64())]), bin=at, y=y[at], s=s[at], n=n[at])

    bins = rows.mapInArrow(binned, "bin int, y double, s double, n double").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("bin").collect()
    n = np.array([r["n"] for r in bins])
    model.edges, model.value = np.array([r["s"] for r in bins]) / n, isotonic(np.array([r["y"] for r in bins]), n)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) of every row of the statistics; without a model the score is 0.5.

    A null or empty text has the statistics of no bytes and is scored like any other.  Each row is scored by
    its own text, whatever its id; other columns of the documents don't matter.
    """
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    sent = stats.sparkSession.sparkContext.broadcast(model)

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
        for batch in batches:
            if batch.num_rows:
                s = sent.value.calibrated(sent.value.raw(_matrix(batch, STATS)))
                yield B.row_batch(schema, doc_id=batch.column(0), score=s, predicted=(s >= 0.5).astype(np.int32))

    return stats.select("doc_id", *STATS).mapInArrow(run, "doc_id long, score double, predicted int")
