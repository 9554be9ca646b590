"""Raw JSON-RPC text in, JSON documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RPC_TEXT = T.StructType([T.StructField("body", T.StringType())])


def read_rpc_json(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """One response or notification per line, as ``body``. Parsing is in ``operators.parse``."""
    if stream:
        reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = spark.read
    return reader.text(path).withColumnRenamed("value", "body")


def with_export_time(df: DataFrame, exported_at: str) -> DataFrame:
    """Rows as JSON text with the time of the export."""
    return df.select(F.to_json(F.struct("*", F.lit(exported_at).alias("exportedAt"))).alias("value"))


def export_json(df: DataFrame, path: str, exported_at: str | None = None) -> None:
    """Write rows as JSON lines, in parallel; with ``exported_at`` each row carries it."""
    if exported_at is None:
        df.write.json(path)
    else:
        with_export_time(df, exported_at).write.text(path)
