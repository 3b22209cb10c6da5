"""The numbered queries: each operator on its whole table with production parameters, and DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import binary_output, collocations, conversations, fingerprints, html_text, mixing, neardup, packing, pii, quality, secret_scan, simhash, toxicity
from barwright.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.chained(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.joined(table(spark, sf_dir, "documents"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.round_trip(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.reported(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bloom_fingerprints, op2_mix_sources, op3_personal_data, op4_toxicity, op5_quality_outliers, op6_secret_ownership, op7_ngram_jaccard, op8_page_text, op9_retrieval_packing, op10_token_files, op11_collocations, op12_simhash_components, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.oracle(), "op6_secret_ownership": secret_scan.oracle(), "op11_collocations": collocations.oracle(), "op13_conversation_repair": conversations.oracle()}
