"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is
written as Parquet and read again as the documents of the next stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm import decontaminate, language_profiles, ngram_join, packing, secret_scan
from skyledger.llm.common import prepared, table, written

SEQUENCE_TOKENS = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; what is in none goes."""
    prepared(spark)
    names, prototypes = language_profiles.learn(docs.where(~language_profiles.held_out("doc_id")))
    return language_profiles.with_language(docs, names, prototypes)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of similar ones: that of the least doc_id."""
    prepared(spark)
    return ngram_join.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    prepared(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the credentials that look live masked."""
    prepared(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its place in the document and in its sequence."""
    prepared(spark)
    pieces = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS)
    return packing.pack(pieces.drop("ids"), SEQUENCE_TOKENS).drop("piece")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packed)]
ORACLE_SQL = None  # learned languages, edit distance and token ids are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
