"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, conversation_repair, decontaminate, embedding_dedup, embedding_whitening, language_id, licenses, ngram_join, quality_crf, repeated_text, token_counts, toxicity

BPE_RANKS = "byte_bpe_50k.tiktoken"
UNIGRAM_PIECES = "piece_bpe_32k.model"


def ranks() -> dict[bytes, int]:
    return bpe.load_ranks(public_tokenizers.path(BPE_RANKS))


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(common.table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m[0], m[1]))
    return out.withColumn("mask", F.array_join(spans, ","))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    pieces, byte_fallback = token_counts.load_vocabulary(public_tokenizers.path(UNIGRAM_PIECES))
    counted = docs.select("doc_id", token_counts.token_counts(docs, pieces, byte_fallback).alias("c"))
    return counted.select("doc_id", "c.n_tokens", "c.best_score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), ranks()).drop("ids")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language_id.fit_documents(docs)
    found = docs.select("doc_id", language_id.language(docs, model).alias("p"))
    return found.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "p.lang_pred", "p.score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality_crf.fit_documents(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality_crf.quality(docs, model).alias("score"))
    return scored.select(
        "doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality_crf.GOOD).cast("int").alias("predicted"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(common.table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit_documents(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.toxicity(docs, model).alias("score"))
    return scored.select(
        "doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(rows), rows)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text.digests(repeated_text.remove_repeats(common.table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_crf": op6_quality_crf,
    "op7_license_scan": op7_license_scan,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE: dict[str, str] = {
    "op1_chat_perspectives": chat.PERSPECTIVES_SQL,
    "op9_ngram_join": ngram_join.COMPONENTS_SQL,
    "op13_suffix_dedup": repeated_text.REMOVED_SQL,
}
