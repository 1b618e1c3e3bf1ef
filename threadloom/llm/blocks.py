"""Arrow text columns as flat numpy arrays, and the shared work folder.

All operators that run Python work on whole Arrow batches: a text column is one byte array with
document offsets, and tokenizing, hashing and counting are numpy passes over it.  A batch is cut
into blocks of about ``BLOCK_BYTES`` so that a worker's memory stays bounded; a document is never
cut, so a longer document is a block of its own.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: Bytes of one bucket of a bucketed stage; the number of buckets follows the input's size.
BUCKET_BYTES = 8 << 20
#: Partitions of a bucketed stage; more buckets share them.
MOST_PARTITIONS = 1 << 17
#: Bytes of the Arrow batches that the JVM hands to Python, where the session sets none.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: A task holds a row group of its file in memory; those of 128 MB that are the default take much of a small executor.
WRITE = {"parquet.block.size": str(32 << 20)}
#: A table of at most so many rows of a few bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A table of files of at most so many bytes may be broadcast.
BROADCAST_BYTES = 16 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def work_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster it is an error, since
    other machines wouldn't see such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/threadloom-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> bool:
    """Removes this application's stored tables; queries' results that haven't been written or collected by then are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, since a batch of long texts is held by the JVM and the worker at once; a bound of the session's own stays."""
    if not spark.sparkContext.getConf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and what an idle one keeps lessens what the others can have."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function, which releases memory when a task ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def stored(df: DataFrame, name: str, files: int | None = None, **options: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends here, and a lost executor costs nothing that was written.

    ``files`` bounds the number of files of a table that is small for its number of partitions.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.options(**WRITE, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of the rows in bytes, which is the files' size for a scan; where it knows none, the lengths of texts and 8 bytes a row are summed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 56:
        texts = [F.coalesce(F.octet_length(f.name).cast("long"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
        size = df.agg(F.coalesce(F.sum(sum(texts, F.lit(8).cast("long"))), F.lit(0)).alias("b")).first()["b"]
    return size


def bucket_count(df: DataFrame, bucket_bytes: int = BUCKET_BYTES, least: int = 8) -> int:
    """Buckets for a stage over these rows, in proportion to their bytes and without a bound."""
    return max(least, input_bytes(df) // bucket_bytes)


def gathered(df: DataFrame, buckets: int, *order: str) -> DataFrame:
    """The rows of each value of the column ``bucket`` in one partition, a bucket to a partition while there are at most MOST_PARTITIONS.

    Where there are more, a partition holds several buckets one after the other.  Rows are sorted by
    ``order`` in a bucket.
    """
    parts = min(buckets, MOST_PARTITIONS)
    out = df.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int"))
    by = [*(["bucket"] if buckets > parts else []), *order]
    return out.sortWithinPartitions(*by) if by else out


def per_bucket(batches: Iterator[pa.RecordBatch], bucket: int = 0) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches of each bucket in turn, cut where the bucket changes; each must be used up before the next."""
    rest: list[pa.RecordBatch] = []

    def own() -> Iterator[pa.RecordBatch]:
        now = None
        while True:
            batch = rest.pop() if rest else next(batches, None)
            if batch is None:
                return
            if not batch.num_rows:
                continue
            k = batch.column(bucket).to_numpy(zero_copy_only=False)
            if now is None:
                now = k[0]
            n = len(k) if (k == now).all() else int(np.argmax(k != now))
            if n < len(k):
                rest.append(batch.slice(n))
            if n:
                yield batch.slice(0, n)
            if rest:
                return

    while True:
        first = rest.pop() if rest else next(batches, None)
        if first is None:
            return
        if first.num_rows:
            rest.append(first)
            yield own()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(batch: pa.RecordBatch, column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of the blocks of a batch; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + block_bytes, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b - a, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(sep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators, and each document's first word (with the total last)."""
    n = len(sep)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    word = ~sep
    first = word.copy()
    first[1:] &= sep[:-1] | edge[1:n]
    last = word
    last[:-1] &= sep[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, from eight bytes at a time; exact for words of up to eight bytes but for the length's mixing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix((lanes[starts] & _KEEP[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _M3))
    more = np.flatnonzero(length > 8)
    at = 8
    while len(more):
        if at >= 256:
            for i in more:
                h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            break
        rest = np.minimum(length[more] - at, 8)
        h[more] = mix((h[more] * _M3) ^ (lanes[starts[more] + at] & _KEEP[rest]))
        at += 8
        more = more[length[more] > at]
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that begin at each word; those over a document's end must be dropped by the caller."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for j in range(1, k):
        h *= _M3
        h += words[j : j + m]
    return mix(h)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word, from the documents' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """Integer ids as int64; a null id counts as the least integer."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
    return col.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after the other; the receiver knows their types."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n, out, at = len(raw) // sum(sizes), [], 0
    for t, s in zip(types, sizes, strict=True):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * s
    return out


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket that occurs, in order."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part
