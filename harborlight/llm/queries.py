"""The queries of this subpackage, each over its whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_format, html_extract, length_buckets, line_dedup, minhash, mixing, pii, quality, topk, toxicity
from .common import load


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_digest(load(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(load(spark, sf_dir, "documents"), weights=mixing.WEIGHTS)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digest(chat_format.with_probe(load(spark, sf_dir, "conversations")))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(load(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(load(spark, sf_dir, "documents"))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack_lengths(load(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_exact_topk, op2_pii_surrogates, op3_mix_sources, op4_chat_format, op5_html_extract, op6_line_dedup, op7_length_buckets, op8_quality_rules, op9_minhash_dedup, op10_toxicity)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    known = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return known | {
        "op1_exact_topk": topk.ORACLE_SQL,
        "op3_mix_sources": mixing.ORACLE_SQL,
        "op4_chat_format": chat_format.ORACLE_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
    }
