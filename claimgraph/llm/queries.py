"""Queries of this package: production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, fingerprint, kneser_ney, license_scan, mixing, near_dedup, preferences, secret_scan, sentencepieces, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("entropy", F.round("entropy", 9))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(preferences.mismatched_replies(table(spark, sf_dir, "conversations")))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(table(spark, sf_dir, "documents"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("sketch", F.array_join(F.transform("sketch", lambda x: x.cast("string")), ","))


def op10_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_license_scan, op2_sentencepieces, op3_toxicity, op4_near_dedup, op5_mixing, op6_secret_scan, op7_preferences, op8_fertility, op9_kneser_ney, op10_fingerprints, op10_pairs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.license_sql(),
        "op6_secret_scan": secret_scan.secret_sql(),
        "op7_preferences": preferences.preference_sql(),
        "op10_fingerprints": fingerprint.fingerprint_sql(),
    }
