"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, other text is unlabelled (it may be toxic).  A logistic
model over hashed words is trained in numpy on the risk  pi R+(P) + max(0, R-(U) - pi R-(P)),
pi being the class prior, so that unlabelled text isn't taken for clean text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BITS = 20
#: Bounds of the training sample in documents (picked by a hash of doc_id), and the rows a word must occur in to have a weight.
POSITIVES, UNLABELLED, LEAST_ROWS = 3_000, 12_000, 3
#: A word has a weight if its share of the positives is so many standard errors from its share of the unlabelled.
SCREEN = 4.0
STEPS, RATE, L2 = 300, 0.05, 1e-4


def word_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each document).  Words are runs of ASCII letters and digits and all other bytes over 127, lower-cased A-Z."""
    low = B.LOWER[data]
    starts, ends, first = B.word_spans(_SEP[low], offs)
    return (B.word_hashes(low, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), first


_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def distinct(buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, documents) without repeats, by document."""
    key = np.unique((B.owners(first) << BITS) | buckets)
    return key & ((1 << BITS) - 1), key >> BITS


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE, l2: float = L2, least: int = LEAST_ROWS) -> tuple[np.ndarray, float]:
    """(weights of all buckets, bias): Adam on the non-negative risk with logistic loss and an l2 term.

    Where the corrected negative part is below zero its gradient is reversed alone, as the non-negative
    estimator asks.  Sample rows are sets of buckets; a bucket in fewer than ``least``
    positives, or about as common in both kinds (see SCREEN), has weight 0.
    """
    rows = pos + unl
    n_pos = len(pos)
    flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    from_pos = np.repeat(np.arange(len(rows)) < n_pos, [len(r) for r in rows])
    in_pos, in_unl = np.bincount(flat[from_pos], minlength=1 << BITS), np.bincount(flat[~from_pos], minlength=1 << BITS)
    p_unl = (in_unl + 0.5) / (len(unl) + 1)
    z = (in_pos / max(n_pos, 1) - p_unl) / np.sqrt(p_unl * (1 - np.minimum(p_unl, 1 - 1e-9)) * (1 / max(n_pos, 1) + 1 / max(len(unl), 1)))
    kept = np.flatnonzero((in_pos >= least) & (np.abs(z) >= SCREEN))
    where = np.full(1 << BITS, -1, np.int64)
    where[kept] = np.arange(len(kept))
    use = where[flat] >= 0
    col, doc = where[flat][use], doc[use]
    w, b = np.zeros(len(kept)), -2.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    is_pos = np.arange(len(rows)) < n_pos
    for t in range(1, steps + 1):
        g = np.bincount(doc, w[col], len(rows)) + b
        s = sig(g)
        softplus = np.logaddexp(0, g)
        corrected = softplus[~is_pos].mean() - prior * softplus[is_pos].mean()
        plus = np.where(is_pos, prior * (s - 1) / max(n_pos, 1), 0)
        minus = np.where(is_pos, -prior * s / max(n_pos, 1), s / max(len(unl), 1))
        d = plus + minus if corrected >= 0 else -minus
        grad = np.append(np.bincount(col, d[doc], len(kept)) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(1 << BITS)
    out[kept] = w
    return out, float(b)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """A model from documents (doc_id, text) and labels (doc_id, toxic); rows to learn from are the caller's choice.

    The class prior is the toxic share of the labels.  Without a positive label the model is constant
    and says clean.  The labels that join documents are at most ``positives`` rows.  Several labels of an id
    count as their greatest; rows that share an id are each a row with that label, equal rows are learnt from
    each, and a row without id is never labelled but may be taken as unlabelled.  Other columns don't matter.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("p")).first()
    if not count["p"]:
        return np.zeros(1 << BITS), -4.0
    # A share of all 63-bit hashes, so that a bound holds however many rows there are.
    share = lambda name, n: F.shiftrightunsigned(F.xxhash64(F.lit(name), F.col("doc_id")), 1) < F.lit(min(int(n * (1 << 63)), (1 << 63) - 1))
    some = known.where((F.col("toxic") == 1) & share("toxic", positives / count["p"])).select("doc_id", F.lit(1).alias("is_p"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left")
    picked = rows.withColumn("is_u", share("unlabelled", unlabelled / max(docs.count(), 1))).where(F.col("is_u") | F.col("is_p").isNotNull())

    @B.tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("is_p", pa.bool_()), ("is_u", pa.bool_()), ("blob", pa.binary())])
        for batch in batches:
            p, u = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, n, data, offs in B.text_blocks(batch):
                bucket, doc = distinct(*word_buckets(data, offs))
                cut = np.searchsorted(doc, np.arange(n + 1))
                yield B.row_batch(schema, is_p=p[a : a + n], is_u=u[a : a + n], blob=[B.pack(bucket[i:j].astype(np.uint32)) for i, j in zip(cut[:-1], cut[1:], strict=True)])

    pos, unl = [], []
    sample = picked.select("text", F.col("is_p").isNotNull().alias("is_p"), "is_u").mapInArrow(features, "is_p boolean, is_u boolean, blob binary")
    for r in sorted(sample.collect(), key=lambda r: bytes(r["blob"])):  # any order of tasks gives the same model
        x = np.frombuffer(bytes(r["blob"]), np.uint32)
        if r["is_p"]:
            pos.append(x)
        if r["is_u"]:
            unl.append(x)
    return train(pos, unl, count["p"] / count["n"])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, predicted) of every row by its own whole text, whatever its id; a null or empty text has the score of no words, other columns don't matter."""
    weights, bias = model
    kept = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((kept.astype(np.uint32), weights[kept], bias))

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
        at, w, b = sent.value
        table = np.zeros(1 << BITS)
        table[at] = w
        for batch in batches:
            for a, n, data, offs in B.text_blocks(batch):
                bucket, first = word_buckets(data, offs)
                use = table[bucket] != 0
                key = np.unique((B.owners(first)[use] << BITS) | bucket[use])
                g = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], n) + b
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                yield B.row_batch(schema, doc_id=batch.column(0).slice(a, n), score=s, predicted=(s >= 0.5).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
