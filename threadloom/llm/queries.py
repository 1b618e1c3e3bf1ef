"""The registered queries of the training-data operators: thin, over whole tables, digests derived from the operators' outputs."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship
from . import blocks, decontam, fmindex, langid, line_rules, media, merkle, ngram_join, packing, quality, sharding, toxicity, urlfilter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    blocks.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer's file: THREADLOOM_TOKENIZER, or the installed package's."""
    if p := os.environ.get("THREADLOOM_TOKENIZER"):
        return p
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode(media.store(table(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fmindex.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = fold(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs.where(known), labels.where(known))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.stored_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = quality.document_stats(docs)
    model = quality.fit(stats, labels.where(fold(F.col("doc_id"), 3) != 1))
    return quality.score(stats, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.audit(table(spark, sf_dir, "documents"), tampered=fold(F.col("doc_id"), 5) == 0)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = line_rules.judge(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_media, op2_url_filter, op3_substring_dedup, op4_decontamination, op5_language_id, op6_toxicity, op7_sharding, op8_packing, op9_ngram_join, op10_quality, op11_merkle, op12_line_rules, op13_whitening]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
