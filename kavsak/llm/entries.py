"""Queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm_scoring, mixing, near_join, pii, quality_ranking, quality_rules, substring_dedup, suffix_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, is_: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Held-out rows by crc32 of the doc_id as text."""
    return lambda doc_id: is_(F.crc32(doc_id.cast("string").cast("binary")) % n)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lm_scoring.lm_scoring(_read(spark, sf_dir, "documents"), good)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), fold(5, lambda r: r == 0))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents")).drop("kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents")).drop("kept")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), fold(3, lambda r: r == 1))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_read(spark, sf_dir, "documents")).drop("p_good")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    every = (op1_lm_scoring, op2_pii, op3_near_join, op4_toxicity, op5_suffix_dedup, op6_substring_dedup, op7_decontaminate, op8_quality_ranking, op9_mixing, op10_quality_rules)
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
