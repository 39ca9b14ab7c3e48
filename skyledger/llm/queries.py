"""The registered queries of the corpus operators: name -> function of (session, folder with the tables)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm import balanced_shards, decontaminate, hard_negatives, language_profiles, metric_search, ngram_join, packing, passage_dedup, secret_scan, token_counts, toxicity, vector_codes, warc_archive
from skyledger.llm.common import prepared, table

Query = Callable[[SparkSession, str], DataFrame]

_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    def bind(function: Query) -> Query:
        return lambda spark, sf_dir: function(prepared(spark), sf_dir)

    return {name: bind(function) for name, function in _registry.items()}


@query
def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced_shards.sized(table(spark, sf_dir, "documents", "doc_id", "text"))
    placed = balanced_shards.assign(rows, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_metric_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 5, F.col("vec_id") % 50 == 0)


@query
def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.passages(table(spark, sf_dir, "documents", "doc_id", "text")).drop("row_number")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query
def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = language_profiles.held_out("doc_id")
    names, prototypes = language_profiles.learn(docs.where(~out))
    return language_profiles.classify(docs.select("doc_id", "text", out.alias("held_out")), names, prototypes)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    packed = packing.pack(pieces.drop("ids"), 2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_archive.archive_folder(spark)
    rows = warc_archive.with_responses(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    index = warc_archive.write_archives(rows, folder)
    return warc_archive.read_records(index, folder, payloads=False).drop("url", "payload")


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents", "doc_id", "text"), language_profiles.held_out("doc_id")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~out))
    scored = toxicity.with_scores(docs.select("doc_id", "text", out.alias("held_out")), model, keep_text=False)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, flipped)
