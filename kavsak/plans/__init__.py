"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more  # noqa: F401  registers its queries
from .queries import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f):
        return lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    return {name: bound(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
