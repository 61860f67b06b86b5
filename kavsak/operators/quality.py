"""Row quality: flags, filters, duplicates, routing of suspicious rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes a text suspicious.
SHORT, FEW_WORDS, LONG = 10, 2, 180


def n_words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[^\s]+"))


def flags(x: Column) -> dict[str, Column]:
    """Lengths, counts and whether the text is suspicious."""
    digits = F.regexp_count(x, F.lit(r"[0-9]"))
    bad = (F.length(x) < SHORT) | (n_words(x) < FEW_WORDS) | (F.length(x) > LONG) | (digits == 0)
    return {"char_len": F.length(x), "word_len": n_words(x), "digit_count": digits, "punct_count": F.regexp_count(x, F.lit(r"[!-/:-@\[-`{-~]")), "is_suspicious": bad.cast("int")}


def usable(x: Column, least: int = 6) -> Column:
    """Not NULL, not punctuation and blanks only, not shorter than ``least``."""
    return F.coalesce(x.isNotNull() & ~x.rlike(r"^[\s!-/:-@\[-`{-~]*$") & (F.length(x) >= least), F.lit(False))


def copies(df: DataFrame, key: str, name: str = "copies") -> DataFrame:
    """``df`` with the number of rows that share the key. Only digests are counted and joined, not the texts."""
    keyed = df.withColumn("_digest", F.sha2(F.col(key).cast("binary"), 256))
    found = keyed.groupBy("_digest").agg(F.count("*").alias(name))
    return keyed.join(found.withColumnRenamed("_digest", "_d"), F.col("_digest").eqNullSafe(F.col("_d"))).drop("_digest", "_d")


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: least by ``order``, combined before the shuffle."""
    rest = [c for c in df.columns if c != order]
    least = df.groupBy(F.sha2(F.col(key).cast("binary"), 256)).agg(F.min(F.struct(order, *rest)).alias("_s"))
    return least.select(*(F.col(f"_s.{c}").alias(c) for c in df.columns))


def bad(x: Column, least: int = 6) -> Column:
    """Blank, shorter than ``least`` or nothing but punctuation."""
    return ~usable(x, least)


def bad_either(raw: Column, clean: Column, least: int = 6) -> Column:
    """Bad as given or as cleaned."""
    return bad(raw, least) | bad(clean, least)


def foreign(x: Column) -> Column:
    """Whether a text has a character other than word characters, Turkish letters, blanks and the marks of addresses."""
    return x.rlike(r"(?U)[^\w\sçğıöşüÇĞİÖŞÜ.:/-]")


def routed(df: DataFrame, flag: str = "is_suspicious") -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to look at."""
    return df.where(F.col(flag) == 0), df.where(F.col(flag) == 1)


def report(suspicious: DataFrame, rest: DataFrame) -> DataFrame:
    """What each stage of cleaning drops: bad addresses, equal rows, equal clean addresses; one row of six counts.

    Rows have address and address_clean. Digests are counted, not the texts.
    """
    good = suspicious.where(~bad_either(F.col("address"), F.col("address_clean")))
    digest = lambda *cs: F.sha2(F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cs)), 256)
    stages = good.agg(F.count("*").alias("g"), F.countDistinct(digest(*good.columns)).alias("u"), F.countDistinct(digest("address_clean")).alias("c"))
    one = suspicious.agg(F.count("*").alias("n")).crossJoin(F.broadcast(stages)).crossJoin(F.broadcast(rest.agg(F.count("*").alias("r"))))
    return one.select(F.col("n").alias("suspicious_rows_in"), (F.col("n") - F.col("g")).alias("dropped_bad_address"), (F.col("g") - F.col("u")).alias("dropped_exact_dups"), (F.col("u") - F.col("c")).alias("dropped_clean_dups"), F.col("c").alias("lowconf_rows_out"), F.col("r").alias("baseline_rows"))
