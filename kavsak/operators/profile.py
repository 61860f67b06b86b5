"""Profiles of tables and texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import positions


def missing(df: DataFrame) -> DataFrame:
    """Missing values of each column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr("_n", f"stack({len(df.columns)}, {pairs}) AS (column_name, missing)").select("column_name", "missing", F.round(F.coalesce(F.try_divide(100.0 * F.col("missing"), F.col("_n")), F.lit(0.0)), 3).alias("missing_pct"))


def describe(df: DataFrame, column: str, quantiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("min"), *(F.round(F.percentile(c, F.lit(q)), 6).alias(f"p{round(100 * q):02d}") for q in quantiles), F.max(c).alias("max"))


def bins(df: DataFrame, column: str, edges: Sequence[int]) -> DataFrame:
    """Rows in each right-closed bin, empty bins included; values outside are left out."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low long, high long"))
    found = df.select(sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges[1:]), F.lit(0)).alias("bin"), F.col(column).alias("v")).where((F.col("v") > edges[0]) & (F.col("v") <= edges[-1])).groupBy("bin").count()
    return table.join(found, "bin", "left").select("low", "high", F.coalesce("count", F.lit(0)).alias("n"))


def counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values by frequency; a limit sorts by count, then value."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column).limit(top) if top else out


def diversity(df: DataFrame, column: str) -> DataFrame:
    """1 - sum of squared shares, and how many values there are."""
    per = df.groupBy(column).agg(F.count("*").alias("c"))
    return per.agg(F.count("*").alias("n_values"), F.sum("c").alias("n_rows"), F.round(1 - F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c")), 6).alias("diversity"))


def presence(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Rows that hold each word, lower-case, in one pass."""
    one = df.agg(*(F.count_if(F.lower(column).rlike(rf"\b{re.escape(w)}\b")).alias(f"w{i}") for i, w in enumerate(words)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(w).alias("token"), F.col(f"w{i}").alias("n")) for i, w in enumerate(words)))))


def characters(df: DataFrame, key: str, column: str) -> DataFrame:
    """Shares of digits, letters, blanks and ASCII punctuation; 0 for an empty text."""
    x = F.col(column)
    share = lambda p: F.round(F.coalesce(F.try_divide(F.regexp_count(x, F.lit(p)).cast("double"), F.length(x)), F.lit(0.0)), 6)
    return df.select(key, share("[0-9]").alias("digits"), share("[A-Za-z]").alias("letters"), share(r"[ \n\t\r]").alias("blanks"), share(r"[!-/:-@\[-`{-~]").alias("punctuation"))


def ngrams(df: DataFrame, column: str, n: int) -> DataFrame:
    """Frequencies of runs of n words; words are lower-case runs of ASCII letters and digits."""
    w = F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0))
    grams = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *(F.get("w", i + j) for j in range(1, n))))
    return df.select(w.alias("w")).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def near_positions(df: DataFrame, order: str, column: str, reach: int, least: float) -> DataFrame:
    """Pairs less than ``reach`` places apart whose character 3-gram sets have a Jaccard similarity of ``least`` or more.

    Two sets that are so alike share one of the rarest grams of each, as many as may differ and one more. Rows are joined
    by these grams and by bands of ``reach`` places (a row meets its own band and the next), then compared exactly.
    """
    bare = F.replace(column, F.lit(" "), F.lit(""))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 2, F.lit(1))), lambda i: F.xxhash64(F.substring(bare, i, F.lit(3)))))
    rows = positions(df.select(F.col(order).alias("i"), F.col(column)), "i", "place").where(F.length(bare) >= 3).select("i", "place", grams.alias("g"))
    often = rows.select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    rare = rows.select("i", F.explode("g").alias("x")).join(often, "x").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("r"))
    few = F.size("r") - F.ceil(least * F.size("r")).cast("int") + 1
    keyed = rows.join(rare, "i").select("i", "place", "g", F.floor(F.col("place") / reach).alias("band"), F.explode(F.slice("r", F.lit(1), few)).alias("x")).select("i", "place", "g", "band", "x.x")
    right = keyed.select(F.col("i").alias("j"), F.col("place").alias("q"), F.size("g").alias("m"), "x", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    size = F.size("g")
    pairs = keyed.join(right, ["band", "x"]).where((F.col("q") > F.col("place")) & (F.col("q") < F.col("place") + reach) & (F.least(size, F.col("m")) >= least * F.greatest(size, F.col("m"))))
    pairs = pairs.select("i", "j").distinct()
    sets = rows.select(F.col("i").alias("k"), "g")
    pairs = pairs.join(sets, F.col("i") == F.col("k")).select("i", "j", "g").join(sets.withColumnRenamed("g", "h"), F.col("j") == F.col("k"))
    once = pairs.select("i", "j", F.size("g").alias("a"), F.size("h").alias("b"), F.explode(F.array(F.size(F.array_intersect("g", "h")))).alias("both"))
    once = once.withColumn("similarity", F.col("both") / (F.col("a") + F.col("b") - F.col("both")))
    return once.where(F.col("similarity") >= least).select("i", "j", F.round("similarity", 6).alias("similarity"))


def info(df: DataFrame, *columns: str) -> DataFrame:
    """Rows, and of each column how many different values it has and the percentage that is missing; one row."""
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.count_if(F.col(c).isNull()), F.count("*")), F.lit(0.0)), 6)
    return df.agg(F.count("*").alias("n_rows"), *(x for c in columns for x in (F.countDistinct(c).alias(f"unique_{c}"), share(c).alias(f"missing_{c}_pct"))))


def mean_repeats(df: DataFrame, column: str) -> DataFrame:
    """Different values, rows, and rows a value."""
    return df.agg(F.countDistinct(column).alias("n_values"), F.count("*").alias("n_rows"), F.round(F.coalesce(F.try_divide(F.count("*"), F.countDistinct(column)), F.lit(0.0)), 6).alias("mean_repeats"))


def variants(df: DataFrame, column: str, known: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each word, rows that hold it and, a column each, rows that hold its variants; NULL where a variant isn't its own."""
    x, all_ = F.lower(column), [v for vs in known.values() for v in vs]
    holds = lambda w: F.count_if(x.rlike(rf"\b{re.escape(w)}\b"))
    one = df.agg(*(holds(w).alias(f"w{i}") for i, w in enumerate([*known, *all_])))
    at = {v: f"w{len(known) + i}" for i, v in enumerate(all_)}
    lines = [F.struct(F.lit(w).alias("canonical"), F.col(f"w{i}").alias("canonical_count"), *((F.col(at[v]) if v in vs else F.lit(None).cast("long")).alias(v) for v in all_)) for i, (w, vs) in enumerate(known.items())]
    return one.select(F.inline(F.array(*lines)))


def top_tokens(df: DataFrame, tokens: Column, most: int = 200) -> DataFrame:
    """The most frequent tokens; ties in their order."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def extremes(df: DataFrame, length: Column, order: str, low: int = 15, high: int = 150, most: int = 50) -> DataFrame:
    """The first rows of the short ones and the first of the long ones."""
    first = lambda rows: rows.orderBy(order).limit(most)
    return first(df.where(length <= low)).unionByName(first(df.where(length >= high)))
