"""Places of rows in an order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, bucket: Column, order: Sequence[str], within: Sequence[str] = (), name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in ``order`` among the rows that share ``within``. ``bucket`` has to grow with the
    order and to cut it into parts that fit a task: rows are ordered in their part, parts by their sizes alone."""
    cut = df.withColumn("_bucket", bucket)
    keys = [*within, "_bucket"]
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(c).alias(f"_k_{c}") for c in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cut = cut.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    out = cut.join(sizes, same[0] if len(same) == 1 else same[0] & same[1] if len(same) == 2 else same[0] & same[1] & same[2])
    return out.select(*df.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name))


def positions(df: DataFrame, order: str, name: str = "place", parts: int | None = None) -> DataFrame:
    """Places by a numeric column; the parts lie between quantiles that are looked up first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01))) if parts > 1 else []
    bucket = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    return ranked(df, bucket, [order], name=name)
