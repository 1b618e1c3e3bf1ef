"""Whitening of embeddings by hierarchical SVD merging.

Every partition keeps its count, the exact sums of its vectors, and all singular values and right singular
vectors of its centred rows.  Two such summaries are merged by stacking their scaled vectors, appending one
row that corrects for the difference of their means, and taking the SVD again; no dimension is dropped, so
the last summary has the spectrum of all rows.  Merges go level by level, a few summaries to a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: An entry c counts as floor(SCALE * c) + SHIFT; beyond MOST it counts as MOST.
SCALE, SHIFT, MOST = 1024, 100_000, 1 << 50
COMPONENTS = 8
#: Summaries that one task merges.
FAN = 16
#: Entries of a matrix that a worker holds at once.
BLOCK_ENTRIES = 1 << 19
SUMMARY = "slot long, n long, sums array<string>, s binary, vt binary"
MOMENTS = "slot long, n long, mean binary, m2 binary"


@dataclass
class Summary:
    """Rows seen: their number, exact sums, and the singular values ``s`` and right singular vectors ``vt`` of the centred rows."""

    n: int
    sums: list[int]
    s: np.ndarray
    vt: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        n = len(x)
        high, low = (x >> 25).sum(axis=0), (x & ((1 << 25) - 1)).sum(axis=0)
        sums = [(int(h) << 25) + int(k) for h, k in zip(high, low, strict=True)]
        _, s, vt = np.linalg.svd(centred(x, n, sums), full_matrices=False)
        return Summary(n, sums, s, vt)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        row = math.sqrt(self.n / n * other.n) * gap
        _, s, vt = np.linalg.svd(np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, row]), full_matrices=False)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], s, vt)

    def row(self, slot: int) -> dict:
        return {"slot": slot, "n": self.n, "sums": [str(x) for x in self.sums], "s": self.s.tobytes(), "vt": self.vt.tobytes()}

    @staticmethod
    def read(row) -> Summary:
        s = np.frombuffer(row.s)
        return Summary(int(row.n), [int(x) for x in row.sums], s, np.frombuffer(row.vt).reshape(len(s), -1))


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean as a whole part, what is left of the sums beyond it, and that as a fraction; so no digits are lost to the shift."""
    whole = np.array([round(s / n) if abs(s) < 1 << 53 else s // n for s in sums], np.int64)
    rest = [s - n * int(w) for s, w in zip(sums, whole, strict=True)]
    return whole, np.array(rest, np.int64), np.array([r / n for r in rest])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole, _, fraction = centre(n, sums)
    return (x - whole) - fraction


def _lists(batch: pa.RecordBatch, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, values) of a column of lists; a null list has length -1, a null value isn't finite."""
    col = batch.column(batch.schema.get_field_index(vector))
    off = col.offsets.to_numpy().astype(np.int64)
    values = col.values.slice(off[0], off[-1] - off[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return off[:-1] - off[0], np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(off), -1), values


def _whole_rows(batch: pa.RecordBatch, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows without null or non-finite entries, starts, lengths, values)."""
    starts, lengths, values = _lists(batch, vector)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = starts + np.maximum(lengths, 0)
    return np.flatnonzero((lengths > 0) & (bad[ends] == bad[starts])), starts, lengths, values


def matrices(batch: pa.RecordBatch, vector: str, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-number vectors) of the rows that have ``dims`` finite entries, in blocks."""
    rows, starts, lengths, values = _whole_rows(batch, vector)
    rows = rows[lengths[rows] == dims]
    step = max(1, BLOCK_ENTRIES // dims)
    for a in range(0, len(rows), step):
        own = rows[a : a + step]
        c = values[starts[own][:, None] + np.arange(dims)]
        yield own, np.clip(np.floor(c * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def dimensions(df: DataFrame, vector: str) -> int:
    """The length that most usable vectors have, of several the greatest; 0 for none."""

    def count(batches):
        for batch in batches:
            rows, _, lengths, _ = _whole_rows(batch, vector)
            dims, n = np.unique(lengths[rows], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int64()), pa.array(n, pa.int64())], names=["dims", "n"])

    found = df.select(vector).mapInArrow(B.tidy(count), "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), F.desc("dims")).first()
    return top["dims"] if top else 0


def reduced(rows: DataFrame, combine: Callable[[pd.DataFrame], dict], schema: str, name: str) -> DataFrame:
    """One row of many with a ``slot``: FAN neighbours at a time are combined by a task, each level written before the next."""
    rows = B.stored(rows, f"{name}-0")
    # Slots are the partitions' numbers, so their greatest tells how many levels there are.
    most, level = rows.agg(F.max("slot").alias("m")).first()["m"], 0
    while most is not None and most >= 0 and (most > 0 or level == 0):

        def task(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("slot")
            return pd.DataFrame([{**combine(frame), "slot": int(frame["slot"].iloc[0]) // FAN}])

        # The grouping column comes along as the slot, of which the new one is a FAN-th.
        grouped = rows.groupBy(F.expr(f"slot div {FAN}").alias("_to")).applyInPandas(task, schema)
        level += 1
        rows, most = B.stored(grouped, f"{name}-{level}"), most // FAN
    return rows


def _merge(frame: pd.DataFrame) -> dict:
    rows = [Summary.read(r) for r in frame.itertuples()]
    out = rows[0]
    for other in rows[1:]:
        out = out.merged(other)
    return out.row(0)


def summarised(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """The one summary of all usable rows; no row for none."""

    def run(batches):
        own = None
        for batch in batches:
            for _, x in matrices(batch, vector, dims):
                part = Summary.of(x)
                own = part if own is None else own.merged(part)
        if own is not None:
            r = own.row(TaskContext.get().partitionId())
            types = {"slot": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.string()), "s": pa.binary(), "vt": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c]], t) for c, t in types.items()], names=list(types))

    return reduced(df.select(vector).mapInArrow(B.tidy(run), SUMMARY), _merge, SUMMARY, "whitening-svd")


@dataclass
class Whitening:
    """Components of all rows: ``axes`` (a unit eigenvector a row) by falling eigenvalue, their eigenvalues, and the trace.

    An eigenvalue that is no more than rounding is 0; such a component can't be whitened.  ``identity_error``
    is the largest entry of the whitened rows' covariance minus the identity, over the other components; it is
    null where there are none.
    """

    dims: int
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number vectors; NaN for components without spread."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred(x, self.n, self.sums) @ self.axes.T / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums over dimensions of (n * x - S) ** 2, whether they fit in a long), exact."""
        whole, rest, fraction = centre(self.n, self.sums)
        near = (((x - whole) - fraction) ** 2).sum(axis=1) * float(self.n) ** 2
        sure = near < 9.0e18
        out = np.zeros(len(x), np.int64)
        t = self.n * (x[sure] - whole) - rest
        out[sure] = (t * t).sum(axis=1)
        fits = sure.copy()
        for i in np.flatnonzero(~sure & (near < 9.5e18)):
            d = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums, strict=True))
            if d < 1 << 63:
                out[i], fits[i] = d, True
        return out, fits


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors: those without null or non-finite entries and of the length that most have; None for none."""
    dims = dimensions(df, vector)
    if not dims:
        return None

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                m = Summary.read(r)
                e = m.s**2 / m.n
                k = min(components, dims)
                axes, values = np.zeros((k, dims)), np.zeros(k)
                have = min(k, len(e))
                real = m.s[:have] > m.s[0] * max(m.n, dims) * np.finfo(float).eps if len(e) else np.zeros(0, bool)
                axes[:have], values[:have] = m.vt[:have], np.where(real, e[:have], 0.0)
                turn = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])
                axes *= np.where(turn == 0, 1, turn)[:, None]
                yield pd.DataFrame([{"n": m.n, "sums": [str(x) for x in m.sums], "axes": axes.tobytes(), "e": values.tobytes(), "trace": float(e.sum())}])

    # A few vectors of one length: their size doesn't grow with the rows.
    r = summarised(df, vector, dims).mapInPandas(last, "n long, sums array<string>, axes binary, e binary, trace double").first()
    model = Whitening(dims, r["n"], [int(x) for x in r["sums"]], np.frombuffer(r["axes"]).reshape(-1, dims), np.frombuffer(r["e"]), r["trace"])
    model.identity_error = _identity_error(df, vector, model)
    return model


def _join_moments(a: tuple, b: tuple) -> tuple:
    """(n, mean, sum of products of deviations) of two sets of rows."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] / n * b[0])


def _identity_error(df: DataFrame, vector: str, model: Whitening) -> float | None:
    """Measured on all whitened rows: deviations are taken before products, in blocks, and joined level by level."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None

    def run(batches):
        own = None
        for batch in batches:
            for _, x in matrices(batch, vector, model.dims):
                z = model.project(x)[:, live]
                d = z - z.mean(axis=0)
                part = len(z), z.mean(axis=0), d.T @ d
                own = part if own is None else _join_moments(own, part)
        if own is not None:
            cols = [TaskContext.get().partitionId()], [own[0]], [own[1].tobytes()], [own[2].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slot", "n", "mean", "m2"])

    read = lambda r: (int(r.n), np.frombuffer(r.mean), np.frombuffer(r.m2).reshape(len(live), -1))

    def combine(frame: pd.DataFrame) -> dict:
        parts = [read(r) for r in frame.itertuples()]
        out = parts[0]
        for other in parts[1:]:
            out = _join_moments(out, other)
        return {"slot": 0, "n": out[0], "mean": out[1].tobytes(), "m2": out[2].tobytes()}

    n, _, m2 = read(reduced(df.select(vector).mapInArrow(B.tidy(run), MOMENTS), combine, MOMENTS, "whitening-error").first())
    return float(np.abs(m2 / n - np.eye(len(live))).max())


def transform(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component, numbered from 1.

    ``deviation`` is exact and null where it is beyond a long; ``whitened`` is null for a component without
    spread, ``explained`` is 0 then.  Rows whose vector is null, holds null or non-finite entries or has
    another length than most are dropped; repeated rows and null keys are rows like any other, and other
    columns are left out.  No usable row gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(len(model.values))
    k = len(model.values)

    def run(batches):
        for batch in batches:
            for rows, x in matrices(batch, vector, model.dims):
                z = model.project(x).ravel()
                dev, fits = model.deviations(x)
                m = len(rows)
                cols = [
                    batch.column(batch.schema.get_field_index(key)).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(np.repeat(dev, k), mask=np.repeat(~fits, k)),
                    pa.array(z, mask=np.isnan(z)),
                    pa.array(np.tile(explained, m)),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(key, vector).mapInArrow(B.tidy(run), schema)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """All usable rows whitened by the model of all usable rows."""
    return transform(df, fit(df, vector, components), key, vector)
