"""Truncated SVD of long-form term weights by subspace iteration, and clusters of the reduced rows.

A pass multiplies the basis by the rows and back in numpy over packed rows, some columns of it at a
time, so that a worker never has the whole basis and its product.  As many tasks as there are cores send
their products in chunks that are summed on the executors; the driver holds one matrix of terms times
dimensions, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from . import lloyd, topics

#: Bound of the basis, terms times dimensions times eight bytes, which goes to every executor.
BASIS_BYTES = 256 << 20
#: Bytes of the basis's columns that go to the executors at a time.
COLUMN_BYTES = 16 << 20
#: Terms of a chunk of the product, and rows of the basis made orthogonal at a time.
CHUNK, TALL = 512, 4_096
#: Terms of a row whose rows of the basis are gathered at a time.
GATHERED = 4_096
#: What the session sets while rows are packed, multiplied and clustered: small batches, as workers and JVM hold some of them at once, and no shuffle files of earlier passes.
SESSION = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def vocabulary(weights: DataFrame) -> DataFrame:
    """(term, i): the terms numbered in order; they are as few as the features of the weights."""
    return weights.select("term").distinct().withColumn("i", F.row_number().over(Window.orderBy("term")) - 1)


def packed(weights: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, idx, val): a row's terms by number and their weights; terms that aren't in the vocabulary are left out."""
    met = weights.join(F.broadcast(terms), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("s"))
    return met.select(key, F.col("s.i").alias("idx"), F.col("s.weight").alias("val"))


def _sparse(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts with the end last, term numbers, weights) of a batch whose columns ``at`` and ``at + 1`` are lists."""
    idx, val = batch.column(at), batch.column(at + 1)
    off = idx.offsets.to_numpy()
    return off - off[0], idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)


def _times(off: np.ndarray, idx: np.ndarray, val: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The rows times the basis, row by row, so that what is gathered of the basis doesn't grow with the batch."""
    out = np.zeros((len(off) - 1, basis.shape[1]))
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for c in range(a, b, GATHERED):
            d = min(b, c + GATHERED)
            out[i] += val[c:d] @ basis[idx[c:d]]
    return out


def _add_back(total: np.ndarray, off: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray) -> None:
    """Adds the transposed rows times y; a row has a term once."""
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for c in range(a, b, GATHERED):
            d = min(b, c + GATHERED)
            total[idx[c:d]] += val[c:d, None] * y[i]


def _gram_columns(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """Transposed rows times rows times some columns of the basis."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(basis)
    n, width = basis.shape
    schema = pa.schema([("chunk", pa.int32()), ("blob", pa.binary())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            off, idx, val = _sparse(batch, 0)
            total = np.zeros((n, width)) if total is None else total
            _add_back(total, off, idx, val, _times(off, idx, val, sent.value))
        if total is not None:
            for c in range(0, n, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([total[c : c + CHUNK].tobytes()], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(blob.as_buffer())
                if c in sums:
                    sums[c] += part
                else:
                    sums[c] = part.copy()
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([s.tobytes()], pa.binary())], schema=schema)

    out = np.zeros((n, width))
    kind = "chunk int, blob binary"
    parts = rows.select("idx", "val").coalesce(context.defaultParallelism).mapInArrow(multiply, kind)
    for r in parts.repartition(min(-(-n // CHUNK), context.defaultParallelism), "chunk").mapInArrow(add, kind).collect():
        part = np.frombuffer(bytes(r["blob"])).reshape(-1, width)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
    sent.destroy()
    return out


def _gram_times(rows: DataFrame, basis: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(columns, transposed rows times rows times them), some columns of the basis after the other, whose place the caller may take for the product."""
    width = basis.shape[1]
    step = -(-width // max(1, -(-basis.nbytes // COLUMN_BYTES)))
    for c in range(0, width, step):
        with tables.configured(rows.sparkSession, SESSION):
            product = _gram_columns(rows, np.ascontiguousarray(basis[:, c : c + step]))
        yield slice(c, c + step), product


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of z's columns, made in place, of stretches of rows and then of their triangles."""
    if len(z) <= TALL:
        return np.linalg.qr(z)[0]
    triangles = []
    for c in range(0, len(z), TALL):
        q, r = np.linalg.qr(z[c : c + TALL])
        z[c : c + TALL, : q.shape[1]] = q
        triangles.append(r)
    turn, at = np.linalg.qr(np.vstack(triangles))[0], 0
    for c, r in zip(range(0, len(z), TALL), triangles, strict=True):
        z[c : c + TALL] = z[c : c + TALL, : len(r)] @ turn[at : at + len(r)]
        at += len(r)
    return z


def decompose(rows: DataFrame, n_terms: int, k: int, more: int = 10, passes: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(components as terms times k, singular values) of uncentered rows, by ``passes`` passes of subspace iteration over ``more`` extra dimensions.

    k is cut to the number of terms; no terms give an empty basis.
    """
    width = min(k + more, n_terms)
    if not n_terms:
        return np.zeros((0, 0)), np.zeros(0)
    if n_terms * width * 8 > BASIS_BYTES:
        raise ValueError(f"a basis of {n_terms} terms and {width} dimensions, over {BASIS_BYTES} bytes")
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((n_terms, width)))
    for _ in range(passes):
        for at, product in _gram_times(rows, basis):
            basis[:, at] = product
        basis = _orthonormal(basis)
    inner = np.empty((width, width))
    for at, product in _gram_times(rows, basis):
        inner[:, at] = basis.T @ product
    value, turn = np.linalg.eigh(inner)
    order = np.argsort(value)[::-1][:k]
    turn = turn[:, order]
    for c in range(0, n_terms, TALL):
        basis[c : c + TALL, : turn.shape[1]] = basis[c : c + TALL] @ turn
    return basis[:, : turn.shape[1]], np.sqrt(np.maximum(value[order], 0.0))


def project(rows: DataFrame, key: str, components: np.ndarray, unit: bool = True) -> DataFrame:
    """(key, vec): the rows in the reduced space, of length 1 if ``unit`` (rows of zeros stay)."""
    sent = rows.sparkSession.sparkContext.broadcast(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _times(*_sparse(batch, 1), sent.value)
            if unit:
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(size > 0, size, 1.0)
            off = np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], names=[key, "vec"])

    return rows.select(key, "idx", "val").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vec array<double>")


@dataclass
class ReducedTopics:
    """Clusters of rows reduced by a fitted SVD; new rows' terms beyond the vocabulary don't count."""

    terms: DataFrame
    components: np.ndarray
    singular: np.ndarray
    centres: np.ndarray
    unit: bool

    def transform(self, weights: DataFrame, key: str) -> DataFrame:
        """(key, cluster) of the rows that have a known term."""
        return self.assign(project(packed(weights, self.terms, key), key, self.components, unit=False), key)

    def assign(self, reduced: DataFrame, key: str) -> DataFrame:
        """(key, cluster) of rows (key, vec) in the reduced space, of which the model takes the first dimensions."""
        sent = reduced.sparkSession.sparkContext.broadcast((self.centres, self.unit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, unit = sent.value
            for batch in batches:
                if batch.num_rows and len(centres):
                    at, _ = lloyd.nearest(lloyd.cut(lloyd.rows_of(batch, 1), centres.shape[1], unit), centres)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32))], names=[key, "cluster"])

        return reduced.select(key, "vec").mapInArrow(run, f"`{key}` {reduced.schema[key].dataType.simpleString()}, cluster int")


def fit(weights: DataFrame, key: str, settings: list[tuple[int, int]], unit: bool = True, starts: int = 10, seed: int = 42) -> dict[tuple[int, int], ReducedTopics]:
    """A model for each setting (clusters, dimensions): one decomposition at the most dimensions, whose first ones serve the others, and the best of so many starts of all settings at once."""
    terms = tables.stored(vocabulary(weights))
    return fit_rows(tables.stored(packed(weights, terms, key)), terms, key, settings, unit, starts, seed)[0]


def fit_rows(rows: DataFrame, terms: DataFrame, key: str, settings: list[tuple[int, int]], unit: bool = True, starts: int = 10, seed: int = 42) -> tuple[dict[tuple[int, int], ReducedTopics], DataFrame]:
    """The models of stored rows (key, idx, val) over numbered terms, and the rows in the reduced space (key, vec), stored."""
    components, singular = decompose(rows, terms.count(), max(d for _, d in settings), seed=seed)
    with tables.configured(rows.sparkSession, SESSION):
        reduced = tables.stored(project(rows, key, components, unit=False))
        found = lloyd.fit(reduced.select("vec"), settings, starts, seed, unit)
    return {(k, d): ReducedTopics(terms, components[:, :d], singular[:d], found[k, d][0], unit) for k, d in settings}, reduced


def fit_texts(docs: DataFrame, key: str, text: str, stop: list[str], settings: list[tuple[int, int]], **more) -> tuple[dict[tuple[int, int], ReducedTopics], DataFrame]:
    """The same of texts, whose weights are packed where they are made; a row is a document, whether or not others share its key."""
    with tables.configured(docs.sparkSession, SESSION):
        rows, terms = topics.tfidf_rows(docs, key, text, stop)
        rows = tables.stored(rows)
    return fit_rows(rows, terms, key, settings, **more)
