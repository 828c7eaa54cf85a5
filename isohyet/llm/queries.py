"""The registered queries of this folder, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from isohyet.llm import (
    alignment,
    contamination,
    exact,
    language,
    licenses,
    near,
    negatives,
    oracles,
    packing,
    quality,
    sharding,
    substring,
    suffixes,
    tokens,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.digest(table(spark, sf, "documents"))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.digest(table(spark, sf, "documents"))


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring.digest(table(spark, sf, "documents"))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.languages(table(spark, sf, "documents"))


def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near.digest(table(spark, sf, "documents"))


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.digest(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.digest(table(spark, sf, "documents"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(table(spark, sf, "documents"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignment(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"))


def op13_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.digest(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_quality, op3_sharding, op4_substring_dedup, op5_language_id, op6_near_dedup, op7_token_counts,
        op8_suffix_dedup, op9_decontamination, op10_packing, op11_hard_negatives, op12_token_alignment, op13_license_scan,
    )
}
ORACLES: dict[str, str] = oracles.SQL
