"""Evaluation of predictions, folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinal import ranked


def binary(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy and F1 of the class 1."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    one = df.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    return one.select("n", F.round("accuracy", 6).alias("accuracy"), F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6).alias("f1"))


def multiclass(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, and F1 and F2 as macro, micro and weighted means over all classes met; an undefined share is 0."""
    cells = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g"), F.lit(0).alias("h")), F.struct(F.col(guess).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g"), (F.col(truth) == F.col(guess)).cast("int").alias("h")))).alias("x"))
    per = cells.groupBy("x.c").agg(F.sum("x.t").alias("t"), F.sum("x.g").alias("g"), F.sum("x.h").alias("h"))
    f = lambda b: F.coalesce(F.try_divide((1.0 + b * b) * F.col("h"), b * b * F.col("t") + F.col("g")), F.lit(0.0))
    per = per.select("t", "h", f(1).alias("f1"), f(2).alias("f2"))
    rounded = lambda x, name: F.round(x, 4).alias(name)
    return per.agg(rounded(F.sum("h") / F.sum("t"), "accuracy"), *(rounded(F.avg(f"f{b}"), f"macro_f{b}") for b in (1, 2)), *(rounded(F.sum("h") / F.sum("t"), f"micro_f{b}") for b in (1, 2)), *(rounded(F.sum(F.col(f"f{b}") * F.col("t")) / F.sum("t"), f"weighted_f{b}") for b in (1, 2)))


def _dealt(df: DataFrame, key: str, label: str) -> DataFrame:
    """Places within a class by the key's md5, whose first letters cut the classes into parts."""
    order = F.md5(F.col(key).cast("string").cast("binary"))
    return ranked(df.withColumn("_md5", order), F.substring("_md5", 1, 2), ["_md5", key], [label], "_rank").drop("_md5")


def folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """``df`` with a ``fold``: the classes are dealt out evenly, in the order of the key's md5."""
    return _dealt(df, key, label).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def held_out(df: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """``df`` with ``held``: whether a row is in the first ``share`` of its class, by the key's md5."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.ceil(F.count("*") * share).alias("_most"))
    out = _dealt(df, key, label).join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return out.withColumn("held", F.col("_rank") <= F.col("_most")).drop("_rank", "_label", "_most")


def paired(gold: DataFrame, guess: DataFrame, key: str = "id", value: str = "match") -> DataFrame:
    """Truth and guess of the keys that both tables have, as ``value_true`` and ``value_pred``."""
    a, b = (df.select(F.col(key).alias(k), F.col(value).alias(v)) for df, k, v in ((gold, key, f"{value}_true"), (guess, "_k", f"{value}_pred")))
    return a.join(b, F.col(key) == F.col("_k")).drop("_k")


def _among(truth: str, scores: str, k: int):
    own = F.get(F.col(scores), F.col(truth))
    above = F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < F.col(truth))))
    return F.avg((own.isNotNull() & (F.size(above) < k)).cast("double"))


def top_k(df: DataFrame, truth: str, scores: str, k: int = 3) -> DataFrame:
    """Share of rows whose class, a position in the array of scores, is among the k highest; ties go to the lower class."""
    return df.agg(F.count("*").alias("n"), F.round(_among(truth, scores, k), 6).alias("accuracy"))


def top_k_by(df: DataFrame, fold: str, truth: str, scores: str, k: int = 3) -> DataFrame:
    """``top_k`` of each fold, not rounded."""
    return df.groupBy(fold).agg(F.count("*").alias("n"), _among(truth, scores, k).alias("accuracy"))
