"""The same normalizers, parsers and flags on a stream of files: all of them are expressions, none needs state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import parse as P
from ..functions import text as T
from ..operators import quality as Q


def addresses(spark: SparkSession, folder: str, schema: str = "id long, address string", kind: str = "csv") -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    source = spark.readStream.schema(schema).format(kind)
    return (source.option("header", True) if kind == "csv" else source).load(folder)


def parsed(stream: DataFrame) -> DataFrame:
    """id, address, address_norm, the components, and whether the row is suspicious; for streams and tables alike."""
    clean = T.once(stream.withColumn("address_norm", T.normalize(F.col("address"))), "_clean", P.clean_c(F.col("address")))
    out = T.once(clean, "_parts", P.parse_c(F.col("_clean"))).withColumn("is_suspicious", Q.flags(F.col("_clean"))["is_suspicious"])
    return out.select("id", "address", "address_norm", "_parts.*", "is_suspicious")


def run(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to parquet files; with ``once`` all that has arrived, else on and on."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
