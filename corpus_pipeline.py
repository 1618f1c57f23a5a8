"""A training corpus from raw documents: language, near duplicates, personal data, mixture, tokens.

Every stage takes all documents that the one before it kept, from the Parquet written in between, and all but the last
give back the columns of documents. Other columns of documents, whatever they are called, are left out. Nulls in any
column are kept as they are, but for a missing lang, which the first stage fills in; a null text has no language and goes.
Repeated rows are near copies of each other, so one of them stays. Documents that tie for a place are taken in the order
of their ids. An empty table passes all stages as an empty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, language, mixing, pii, simhash
from lettermill.llm._common import Written, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go; a missing lang is filled in."""
    found = language.identify(docs, language.fit(docs), id_cols=COLUMNS)
    kept = found.filter(F.col("lang_pred") != language.UND)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; n_chars follows the text."""
    masked = docs.select(*COLUMNS).withColumn("text", pii.masker(pii.fit(docs))(F.col("text")))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mixture takes it: not at all, once or twice."""
    return mixing.apply_mix(docs.select(*COLUMNS), mixing.plan_mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mixture, with digests of the ids and of their decoding."""
    return bpe.encode_documents(docs.select(*COLUMNS), id_cols=["doc_id", "lang", "source"], ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Fingerprint components, the tagger and BPE have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written goes when its result is complete."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            done = Written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(done.path)
        if held is not None:
            held.drop()
        docs, held = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
