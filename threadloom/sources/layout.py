"""A table laid out for lookups: by thread and by time, with a manifest of what each file spans.

Rows are dealt into ranges of (thread, time) and sorted, a file a range, with Parquet's Bloom filters on the
thread; a second, narrow table has (time, thread) in the order of time.  A lookup reads the manifest, which
has a row a file, opens the files that may hold an answer and leaves row groups to Parquet's statistics and
filters.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file, and bytes of a row group within it.
FILE_ROWS, GROUP_BYTES = 1_000_000, 16 << 20
#: Threads that a time lookup hands to the thread table as a list; more are joined.
LISTED_THREADS = 1_000


def _ranges(df: DataFrame, order: list[str], file_rows: int) -> DataFrame:
    files = max(1, -(-df.count() // file_rows))
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)


def write_layout(df: DataFrame, path: str, thread: str, time: str, file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES) -> None:
    """Writes ``path``/rows, ``path``/times and ``path``/manifest, over what is there.

    Rows with a null thread or time are kept; no lookup of threads finds the former, none of times the latter.
    A thread of any size is cut over files by time.
    """
    spark = df.sparkSession
    options = {"parquet.block.size": str(group_bytes), f"parquet.bloom.filter.enabled#{thread}": "true", f"parquet.bloom.filter.expected.ndv#{thread}": str(file_rows)}
    _ranges(df, [thread, time], file_rows).write.mode("overwrite").options(**options).parquet(f"{path}/rows")
    narrow = df.where(F.col(time).isNotNull()).select(time, thread).distinct()
    _ranges(narrow, [time, thread], file_rows).write.mode("overwrite").option("parquet.block.size", str(group_bytes)).parquet(f"{path}/times")
    spans = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.count_if(F.col(thread).isNull()).alias("without"), *[f(c).alias(f"{name}_{side}") for c, name in ((thread, "thread"), (time, "time")) for f, side in ((F.min, "first"), (F.max, "last"))])
    spans.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def files_of(spark: SparkSession, path: str, threads: list) -> list[str]:
    """The files whose span of threads holds one of these; a null stands for rows without thread."""
    m = spark.read.parquet(f"{path}/manifest")
    known = [t for t in threads if t is not None]
    near = F.exists(F.array(*map(F.lit, known)), lambda t: t.between(F.col("thread_first"), F.col("thread_last"))) if known else F.lit(False)
    near = near | (F.col("without") > 0) if None in threads else near
    return sorted(r["file"] for r in m.where(near).select("file").collect()) if threads else []


def _rows(spark: SparkSession, path: str, thread: str, threads: list) -> DataFrame:
    files = files_of(spark, path, threads)
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    known = [t for t in threads if t is not None]
    # A single value is pushed down as an equality, for which the Bloom filters are asked.
    own = F.col(thread) == known[0] if len(known) == 1 else F.col(thread).isin(*known)
    return rows.where(own | F.col(thread).isNull() if None in threads else own)


def lookup_threads(spark: SparkSession, path: str, thread: str, threads: list) -> DataFrame:
    """All rows of a few threads, null not being one; no other files are opened than those that may have them."""
    return _rows(spark, path, thread, [t for t in threads if t is not None])


def lookup_times(spark: SparkSession, path: str, thread: str, time: str, start: datetime | date, end: datetime | date) -> DataFrame:
    """All rows with start <= time < end: the narrow table names their threads, whose files alone are opened."""
    times = spark.read.parquet(f"{path}/times")
    # By way of text, so that a time without zone isn't moved by the session's.
    kind = times.schema[time].dataType
    inside = (F.col(time) >= F.lit(str(start)).cast(kind)) & (F.col(time) < F.lit(str(end)).cast(kind))
    found = times.where(inside).select(thread).distinct()
    some = found.limit(LISTED_THREADS + 1).collect()
    if len(some) <= LISTED_THREADS:
        return _rows(spark, path, thread, [r[0] for r in some]).where(inside)
    return spark.read.parquet(f"{path}/rows").where(inside)
