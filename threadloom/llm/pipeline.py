"""A training corpus from raw documents in five stages, each written as Parquet and read again as the next one's documents.

Every stage judges rows, not ids.  A row whose id no other row has goes by that id; rows without an id and
rows that share one get numbers of their own (``rows_told``), so that each is judged by its own text:

- quality: a label of an id counts for all rows that have it; each row stays or goes by its own score;
- near duplicates: of each class of linked rows one stays, that of the least id (a missing id comes last; of
  one id the least text by its MD5), so of identical rows one stays; rows without words are linked with
  nothing and all stay;
- substrings: a window goes where a row with a smaller id has it; a missing id counts as the least, rows of
  one id keep what they share;
- decontamination: each row goes by its own text;
- packing: each row is packed.

Null texts are empty; an empty table gives no rows; columns besides those of documents are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import blocks, decontam, fmindex, ngram_join, packing, quality
from .queries import fold, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _hinted(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= blocks.BROADCAST_ROWS else small


def rows_told(docs: DataFrame, *also: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents with a ``_row`` that no other row has, and (_row, doc_id) of the rows whose ids don't tell them apart.

    ``_row`` is the id where it is there once; the others are numbered, in the order of id and text, beyond
    all ids of the documents and of the tables in ``also``.  Without such rows there is no second table, and
    nothing but the ids is shuffled.
    """
    docs = docs.select(*COLUMNS)
    odd = blocks.stored(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1 or _id is null"), "rows-odd")
    found = odd.agg(F.count("*").alias("ids"), F.sum("n").alias("rows")).first()
    if not found["ids"]:
        return docs.withColumn("_row", F.col("doc_id").cast("long")), None
    limits = [d.agg(F.max("doc_id").cast("long").alias("hi"), F.min("doc_id").cast("long").alias("lo")).first() for d in (docs, *also)]
    hi, lo = max([r["hi"] for r in limits if r["hi"] is not None], default=-1), min([r["lo"] for r in limits if r["lo"] is not None], default=0)
    first = hi + 1 if hi + found["rows"] < 1 << 63 else lo - found["rows"]
    ids = _hinted(odd.select("_id"), found["ids"])
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    alone = docs.join(ids, same, "left_anti").withColumn("_row", F.col("doc_id").cast("long"))
    shared = docs.join(ids, same, "left_semi").withColumn("_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    told = numbered(shared, ["doc_id", "_key"], out="_row").withColumn("_row", F.col("_row") + F.lit(first)).drop("_key")
    return alone.unionByName(told), told.select("_row", F.col("doc_id").cast("long").alias("doc_id"))


def _as_ids(rows: DataFrame) -> DataFrame:
    """The rows under their own numbers, as the operators take them."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def _without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows whose numbers aren't among the bad ones (a column doc_id); these are broadcast while they are few."""
    ids = blocks.stored(bad.select(F.col("doc_id").alias("_bad")), "stage-bad")
    return rows.join(_hinted(ids, ids.count()), rows["_row"] == ids["_bad"], "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go."""
    known = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "quality")
    rows, odd = rows_told(docs, known)
    if odd is not None:
        shared = known.join(odd, "doc_id").select(F.col("_row").alias("doc_id"), "quality")
        known = known.join(odd.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(shared)
    stats = quality.document_stats(_as_ids(rows))
    model = quality.fit(stats, known)
    return _without(rows, quality.score(stats, model).where("predicted = 0"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the least id stays."""
    rows, odd = rows_told(docs)
    found = ngram_join.components(_as_ids(rows)).select("doc_id", "component_id")
    if odd is None:
        return _without(rows, found.where("component_id <> doc_id"))
    # The own id of a row that has a number; others are their own.
    own = odd.select(F.col("_row").alias("doc_id"), F.lit(True).alias("_odd"), F.col("doc_id").alias("_own"))
    named = blocks.stored(found.join(own, "doc_id", "left").withColumn("_own", F.when(F.col("_odd"), F.col("_own")).otherwise(F.col("doc_id"))), "stage-classes")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("_own").isNull(), "_own", "doc_id"))["doc_id"].alias("_kept"))
    return _without(rows, named.select("doc_id").join(kept.select(F.col("_kept").alias("doc_id")), "doc_id", "left_anti"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut; a document of nothing else goes."""
    cut = fmindex.dedup(docs, keep=("text", "lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_words")
    size = F.coalesce(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType), F.col("keep_n_chars"))
    return cut.select("doc_id", F.coalesce("kept_text", "keep_text").alias("text"), F.col("keep_lang").alias("lang"), F.col("keep_source").alias("source"), size.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of a benchmark item go."""
    rows, _ = rows_told(docs)
    return _without(rows, decontam.scan(_as_ids(rows), table(spark, sf_dir, "benchmark")).where(F.size("items") > 0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places."""
    return packing.pack(packing.stored_pieces(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained classifier, which SQL can't express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{blocks.work_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.options(**blocks.WRITE).parquet(path)
        docs = spark.read.parquet(path)
    return docs
