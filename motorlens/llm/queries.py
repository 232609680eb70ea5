"""Queries of the training-data operators over the tables of a folder, and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorlens.llm import byte_bpe, exact_dedup, filter_audit, license_scan, lm_scoring, ngram_join, quality_classifier, quality_rules, source_mix, token_files, toxicity, url_filter, vector_codes
from motorlens.llm.shared import documents, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.query(spark, documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(spark, documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.query(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(spark, table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.query(spark, documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.query(spark, documents(spark, sf_dir))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.query(spark, documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(spark, documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.query(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.query(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(spark, documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.query(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_toxicity, op2_ngram_join, op3_token_files, op4_quality_classifier, op5_url_filter, op6_byte_bpe, op7_exact_dedup, op8_source_mix, op9_quality_rules, op10_lm_scoring,
            op11_filter_audit, op12_license_scan, op13_vector_codes,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_source_mix": source_mix.SQL, "op11_filter_audit": filter_audit.SQL, "op13_vector_codes": vector_codes.SQL,
    }
