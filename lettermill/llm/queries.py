"""The operators of this subpackage applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, language, licences, media, mixing, pii, sharding, simhash, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(folds: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(id_fold(5) == 0, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~held)
    return toxicity.score_documents(docs.select("doc_id", held.alias("held_out"), "text"), model, id_cols=["doc_id", "held_out"])


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs), id_cols=["doc_id"])


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_text(_table(spark, sf_dir, "documents"), id_cols=["doc_id"])
    return media.stored_features(stored, keep=["doc_id", "n_bytes"])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=40)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(id_fold(4) == 2, F.lit(False))
    model = language.fit(docs, train=F.col("doc_id").isNotNull() & ~held)
    return language.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, id_cols=["doc_id", "held_out"])


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), id_cols=["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan_mix(_table(spark, sf_dir, "documents")).rows
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_personal_data": op3_personal_data,
    "op4_media_columns": op4_media_columns,
    "op5_sharding": op5_sharding,
    "op6_licence_scan": op6_licence_scan,
    "op7_language_id": op7_language_id,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mixing": op10_mixing,
}

#: The others have no SQL form: tests/llm holds them against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op2_exact_top_k": topk.SQL, "op10_mixing": mixing.SQL}
