"""Registered queries of this package, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, sql
from .decontam import contamination
from .langid import identify
from .lattice import score
from .licenses import TEMPLATES, scan
from .packing import pack
from .passages import passages
from .quality import verdicts
from .simhash import near_duplicate_classes
from .urls import verdicts as url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_forged_turn(_table(spark, sf_dir, "conversations")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents")).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality_rules": op2_quality_rules,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_license_scan": op9_license_scan,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": sql.QUALITY, "op4_benchmark_decontamination": sql.CONTAMINATION, "op7_chat_formatting": sql.CHAT, "op9_license_scan": sql.licenses(TEMPLATES)}
