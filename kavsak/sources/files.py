"""Reading and writing tables of addresses."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NormalizeConfig, normalize


#: Where windows-1254 differs from latin-1 (bytes 128 to 159 and six Turkish letters); five bytes mean nothing.
LATIN = "".join(map(chr, range(128, 160))) + "\u00d0\u00dd\u00de\u00f0\u00fd\u00fe"


def _turkish() -> str:
    return "".join(ord(c).to_bytes(1, "little").decode("cp1254", "replace") for c in LATIN)


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether all lines of the files are UTF-8."""
    return not spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()


def read_csv(spark: SparkSession, path: str, tolerant: bool = False, limit: int | None = None) -> DataFrame:
    """All columns as strings, header names without mark and blanks. Files that aren't UTF-8 are read as windows-1254.
    With a limit, the first so many rows."""
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "DROPMALFORMED" if tolerant else "PERMISSIVE"}
    if is_utf8(spark, path):
        df = spark.read.options(**options).csv(path)
    else:
        df = spark.read.options(**options).option("encoding", "ISO-8859-1").csv(path)
        table = str.maketrans(LATIN, _turkish())
        df = df.select(*(F.translate(F.col(f"`{c}`"), LATIN, _turkish()).alias(c.translate(table)) for c in df.columns))
    df = df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns))
    return df.limit(limit) if limit is not None else df


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, without a byte order mark."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a line; NULLs are written too."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(province, district) of a JSON object of objects; a missing file gives no rows, a value that is no object no districts."""
    schema = "province string, district string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("province", "inner"))
    return outer.select("province", F.explode_outer(F.map_keys(F.from_json("inner", "map<string,string>"))).alias("district"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def cached(spark: SparkSession, source: str, folder: str, make: Callable[[], DataFrame], *settings: str) -> DataFrame:
    """The result of ``make`` for the files at ``source``, kept in ``folder`` under the md5 of their content and ``settings``."""
    lines = spark.read.text(source).select(F.input_file_name().alias("f"), F.md5(F.col("value").cast("binary")).alias("m"))
    sums = lines.groupBy("f").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("m")).alias("x"), F.sum(F.xxhash64("m").cast("decimal(38,0)")).alias("s")).orderBy("f").collect()
    key = hashlib.md5(repr(([(r["n"], r["x"], str(r["s"])) for r in sums], settings)).encode()).hexdigest()
    path = f"{folder}/{key}.parquet"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def required(df: DataFrame, *columns: str, rows: bool = False) -> DataFrame:
    """``df``, if it has the columns and, if asked for, a row; else an error that names what lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    if rows and df.isEmpty():
        raise ValueError("the table is empty")
    return df


def set_seeds(seed: int = 42) -> int:
    """Seed Python's and NumPy's generators on the driver; returns the seed, to be passed to rand() and fits."""
    random.seed(seed)
    np.random.seed(seed)
    return seed


def normalize_file(spark: SparkSession, source: str, target: str, config: str | None = None) -> DataFrame:
    """Write the table with ``address_norm``; a table without ``address`` gives blank ``address`` and ``address_norm`` only."""
    df = read_csv(spark, source)
    settings = normalize_config(config) if config else NormalizeConfig()
    if "address" not in df.columns:
        df = df.select(F.lit("").alias("address"))
    out = df.withColumn("address_norm", normalize(F.col("address"), settings))
    write_csv(out, target)
    return out


def normalize_config(path: str) -> NormalizeConfig:
    """Switches from a YAML file; a missing file gives the defaults, unknown keys are ignored."""
    file = Path(path)
    found = (yaml.safe_load(file.read_text(encoding="utf-8-sig")) or {}) if file.exists() else {}
    found["regex"] = [(r["pattern"], r.get("repl", "")) for r in found.get("regex") or []]
    return NormalizeConfig(**{f.name: found[f.name] for f in fields(NormalizeConfig) if found.get(f.name) is not None})


def text_column(df: DataFrame, wanted: str | None = None) -> str:
    """The configured column, else address_norm, address, or the first string column."""
    for name in (wanted, "address_norm", "address"):
        if name and name in df.columns:
            return name
    for name, kind in df.dtypes:
        if kind == "string":
            return name
    raise ValueError("no text column")


def shaped(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a template in its order; those that ``df`` lacks are blank."""
    return df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns))
