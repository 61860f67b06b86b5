"""A corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage works on all that its predecessor kept and is written before the next one reads it. All but the last return the
columns of documents; the last adds ``copy``, the number of the copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kavsak.llm import decontaminate, mixing, near_join, pii, quality_rules
from kavsak.llm._spark import materialise


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality_rules.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets."""
    return mixing.mixed(docs)


STAGES = [("quality rules", by_rules), ("near duplicates", one_of_each), ("decontamination", without_benchmark), ("personal data", without_personal_data), ("mixing", to_weights)]

#: Expectation-maximisation, boosting and the cube method can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
