"""The queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import chat_format, decontamination, importance_resampling, language_id, line_dedup, near_duplicates, pii, quality_divergence, sentencepiece_codec, substring_dedup, toxicity, vector_codes, warc
from pairloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_divergence.assess(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_divergence": op5_quality_divergence,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_chat_format": op13_chat_format,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_chat_format": chat_format.ORACLE,
}
