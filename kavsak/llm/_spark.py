"""What the operators share on Spark's side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as the contracts define them; split by its complement.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set")
        found = tempfile.mkdtemp(prefix="kavsak-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With it, Spark drops a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, *consumed: DataFrame) -> DataFrame:
    """Write once to the shared folder and read again: later steps don't repeat the work, and a lost executor loses nothing.

    The shuffles that led to it are dropped at once, and so is ``consumed``: written frames that nothing else reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kavsak/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for old in consumed:
        forget(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._kv_path = path
    return out


def forget(written: DataFrame) -> None:
    """Delete the files of a frame from ``materialise``; frames that read them can't be used any more."""
    path = getattr(written, "_kv_path", None)
    if path:
        spark = written.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def word_array(text: str | Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``rows`` rows (counted here), else leave the join to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (u, v) by alternating large-star and small-star steps.

    Returns (u, v): each node of an edge and the least node of its component (itself included). Nothing is collected
    but the number of changes. Hot nodes are safe: minima are combined before the shuffle and joined back.
    """
    cur = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialise(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), cur)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.union(cur.select(F.col("v").alias("u"), "v")).distinct()
