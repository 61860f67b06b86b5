"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the copies each of its documents should get: whole copies are taken at once, the
fraction left is an inclusion probability. In the flight phase, probabilities of three documents at a time move along the
direction that keeps both the expected words and the expected documents, until one is 0 or 1. Flights run in chunks of a
source of about ``chunk`` documents, then on what the chunks left (two documents each at most), chunk by chunk again, until
one small group a source is left. The landing settles its last one or two documents so that the source's words come
closest to the target.

Null and blank texts have size 0 and take 0. Sources sort by code point, null last, and a null source counts as one.
Repeated rows are documents of their own. Rows with a null doc_id take part. Extra columns pass through in ``mixed`` and
are ignored in ``takes``. An empty table gives an empty result. Chunks, order and the seeds
of a flight depend on doc_id and size alone, so reruns agree.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise

#: Weights by rank of the source, total wanted over total size, the most copies of a source.
WEIGHTS, TOTAL, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
CHUNK, LEVELS = 2_000, 3


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with ``target``: shares by weight, full at ``most`` times the size, the excess reshared.

    With sources in the order of what they can hold for each unit of weight, the full ones come first; the level of the
    others follows from running sums.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (rank % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    full, rest = F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    goal = total * F.sum("source_size").over(Window.partitionBy())
    df = df.withColumn("level", F.try_divide(goal - F.coalesce(full, F.lit(0.0)), rest))
    # the first source whose cap is over the level sets it for all that follow
    df = df.withColumn("open", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("v")))).over(Window.partitionBy()))
    return df.select("source", "source_size", F.least("cap", F.coalesce(F.col("open.v") * F.col("w"), F.col("cap"))).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, seed: int = 0) -> np.ndarray:
    """Move probabilities so that sum(p * size) and sum(p) stay, until two at most are neither 0 nor 1."""
    p, eps, chance = p.copy(), 1e-9, random.Random(seed)
    held: list[int] = []
    for nxt in np.flatnonzero((p > eps) & (p < 1 - eps)).tolist():
        held.append(nxt)
        if len(held) < 3:
            continue
        (a, b, c), (x, y, z) = held, (float(size[i]) for i in held)
        u = (y - z, z - x, x - y)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        q = (float(p[a]), float(p[b]), float(p[c]))
        up = min((1 - v) / d if d > 0 else -v / d for v, d in zip(q, u) if d)
        down = min(v / d if d > 0 else (v - 1) / d for v, d in zip(q, u) if d)
        # either end, so that the expected change of each probability is nothing
        step = up if chance.random() * (up + down) < down else -down
        held = []
        for i, v, d in zip((a, b, c), q, u):
            v += step * d
            v = 0.0 if v < eps else 1.0 if v > 1 - eps else v
            p[i] = v
            if 0 < v < 1:
                held.append(i)
    return np.where(p < eps, 0.0, np.where(p > 1 - eps, 1.0, p))


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Settle what is left (two documents at most): the choice whose words come closest."""
    left = np.flatnonzero((p > 0) & (p < 1))
    goal = float((p * size).sum())
    fixed = float(size[p == 1].sum())
    best, out = None, p.copy()
    for bits in range(1 << len(left)):
        pick = [(bits >> i) & 1 for i in range(len(left))]
        miss = abs(fixed + sum(float(size[i]) for i, b in zip(left, pick) if b) - goal)
        if best is None or miss < best - 1e-9:
            best = miss
            out[left] = pick
    return out


def _level(last: bool):
    """Flight of one chunk, and its landing if it is all that is left of the source."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["k", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        p = fly(df["size"].to_numpy(), df["p"].to_numpy(), int(df["k"].iloc[0]))
        if last:
            p = land(df["size"].to_numpy(), p)
        return df.assign(p=p).drop(columns="part")

    return run


def takes(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, copies, taken."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
    rows = materialise(rows.withColumn("k", F.xxhash64("doc_id", "size")))
    sums = rows.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"), F.count("*").alias("docs"))
    goal = targets(sums.select("source", "source_size"), weights, total, most).withColumnRenamed("source", "s0")
    goal = goal.join(sums.select(F.col("source").alias("s1"), "docs"), F.col("s0").eqNullSafe(F.col("s1"))).drop("s1")
    # one row a source: as many as sources, so the join is left to be planned by size
    df = rows.join(goal, rows.source.eqNullSafe(goal.s0)).drop("s0")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(ratio + 1e-9)
    df = df.select("doc_id", "source", "size", "k", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("p"), F.ceil(F.col("docs") / chunk).alias("chunks"))
    schema = df.schema
    done = None
    for level in range(LEVELS):
        last = level == LEVELS - 1
        parts = F.lit(1) if last else F.greatest(F.ceil(F.col("chunks") / F.lit(float((chunk // 4) ** level))), F.lit(1))
        flown = materialise(df.withColumn("part", F.pmod(F.xxhash64("k", F.lit(level)), parts)).groupBy("source", "part").applyInPandas(_level(last), schema))
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.union(settled)
        df = flown.where("p > 0 and p < 1")
    return done.select("doc_id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"), (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with a column ``copy`` that numbers them from 1."""
    got = takes(docs, **options).select(F.col("doc_id").alias("_kv_d"), F.col("size").alias("_kv_s"), F.coalesce("source", F.lit("")).alias("_kv_o"), F.col("source").isNull().alias("_kv_n"), F.col("copies").alias("_kv_c"))
    same = Window.partitionBy("_kv_d", "_kv_s", "_kv_o", "_kv_n")
    got = got.withColumn("_kv_i", F.row_number().over(same.orderBy(F.desc("_kv_c"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({"_kv_d2": F.col("doc_id").cast("long"), "_kv_s2": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "_kv_o2": F.coalesce(F.col("source").cast("string"), F.lit("")), "_kv_n2": F.col("source").isNull()})
    df = df.withColumn("_kv_i2", F.row_number().over(Window.partitionBy("_kv_d2", "_kv_s2", "_kv_o2", "_kv_n2").orderBy(F.xxhash64(text))))
    df = df.join(got, F.col("_kv_d2").eqNullSafe(F.col("_kv_d")) & (F.col("_kv_s2") == F.col("_kv_s")) & (F.col("_kv_o2") == F.col("_kv_o")) & (F.col("_kv_n2") == F.col("_kv_n")) & (F.col("_kv_i2") == F.col("_kv_i"))).where("_kv_c > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("_kv_c").cast("int"))).alias("copy" if "copy" not in docs.columns else "_kv_copy")
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), copy)
