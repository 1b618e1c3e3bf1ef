"""Chat exports as a stream: a folder of files becomes a table of nodes, each batch written once whatever happens.

Every batch is appended as a folder of its number, which a repeated batch overwrites, so a query that is
killed and started again leaves no row out and none twice.  Reading gives one row for each (thread, node):
that of the export updated last, of equal ones the greatest.  So the table doesn't depend on how files were
dealt into batches, on their order, or on whether a file came twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tables as S

NODE = "thread_id string, update_time double, node_id string, parent_id string, ts double, role string, author_name string, text string"
KEY = ["thread_id", "node_id"]


def nodes(exports: DataFrame) -> DataFrame:
    """The nodes of raw export rows with their export's update_time; rows without thread or nodes give none."""
    rows = S.export_rows(exports).where(F.col("id").isNotNull())
    found = S.export_nodes(rows, "update_time")
    return found.select("thread_id", "update_time", "node_id", "parent_id", "ts", "role", "author_name", "text")


def start(spark: SparkSession, folder: str, table: str, checkpoint: str, lines: bool = False, files_per_batch: int = 100) -> StreamingQuery:
    """A query that appends all files of the folder to the table and ends when there are no more; started again, it goes on where it ended.

    A file holds a JSON list of conversations, or with ``lines`` one conversation a line.
    """
    S.ship(spark)
    raw = spark.readStream.schema(S.EXPORT).option("maxFilesPerTrigger", files_per_batch).json(folder, multiLine=not lines)

    def put(batch: DataFrame, number: int) -> None:
        nodes(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(appended: DataFrame) -> DataFrame:
    """One row for each (thread, node): of the greatest update_time (null is least), then the greatest of its other columns."""
    rest = [c for c in appended.columns if c not in KEY and c != "batch"]
    order = ["update_time", *[c for c in rest if c != "update_time"]]
    return appended.groupBy(*KEY).agg(F.max(F.struct(*order)).alias("_row")).select(*KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now."""
    return latest(spark.read.schema(NODE + ", batch long").parquet(table))


def compact(spark: SparkSession, table: str, to: str) -> None:
    """The table's rows of now as one batch of a new table."""
    read(spark, table).select(*[c.split()[0] for c in NODE.split(", ")]).write.mode("overwrite").parquet(f"{to}/batch=-1")
