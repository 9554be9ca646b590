"""First of every id by event time, with late rows kept aside.

Ids that were let through are a table of runs with the time of each; a merge leaves out those that have expired. Each micro-batch is an ordinary
table here, so a hot id is cut to one row in the tasks, and rows behind the watermark go to a side table instead of being dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotweave.operators.latest import earliest_by
from slotweave.session import numbered
from slotweave.sources.keyed import KeyedTable
from slotweave.streaming.feeds import start_batches

CLOCK = "slotweave-newest"  # the row of the seen table that holds the newest event time; no id may be that


class _Seen(KeyedTable):
    """Rows id and at (microseconds); those before ``since`` are left out whenever runs are merged."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, since: int | None = None):
        super().__init__(spark, path, T.StructType.fromDDL("id STRING, at BIGINT"), ["id"], ["at"], buckets)
        self.since = since

    def reduced(self, rows: DataFrame) -> DataFrame:
        kept = rows if self.since is None else rows.filter((F.col("at") >= self.since) | (F.col("id") == CLOCK))
        return super().reduced(kept)


def dedup_by_event_time(
    messages: DataFrame, within: str, path: str, checkpoint: str, key: str = "message_id", time: str = "ts", seq: str = "seq", every: str | None = None, buckets: int = 64
) -> StreamingQuery:
    """Let the first row of an id through, and one more when ``within`` has gone by since the last one that was, in event time.

    Rows go to ``path/rows``. Those more than ``within`` older than the newest of earlier micro-batches, or without a time, are late: they go to ``path/late``, whatever
    their id. Of the copies of an id in one micro-batch the earliest counts. A null id is an id like any other.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = _Seen(spark, f"{path}/seen", buckets)
        if number <= seen.manifest().batch:
            return
        clock = seen.read_keys(CLOCK).first()
        batch = batch.withColumn("_id", F.coalesce(F.concat(F.lit("i"), F.col(key).cast("string")), F.lit("n"))).withColumn("_at", F.unix_micros(time)).persist()
        try:
            begin = F.lit("2000-01-01").cast("timestamp")
            pause = spark.range(1).select(F.unix_micros(begin + F.expr(f"INTERVAL {within}")) - F.unix_micros(begin)).first()[0]
            bound = clock["at"] - pause if clock else None
            late = F.col("_at").isNull() | (F.col("_at") < bound) if clock else F.col("_at").isNull()
            names = messages.columns
            batch.filter(late).select(*names).write.mode("overwrite").parquet(f"{path}/late/batch_id={number}")
            first = earliest_by(batch.filter(~late), ["_id"], F.struct("_at", seq))
            before = seen.read_buckets_of(first.select(F.col("_id").alias("id")))
            known = before.select(F.col("id").alias("_known"), F.col("at").alias("_before"))
            passed = first.join(known, F.col("_id") == F.col("_known"), "left").filter("_known is null or _at - _before >= " + str(pause))
            passed.select(*names).write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")
            newest = batch.agg(F.max("_at").alias("at")).filter("at is not null").select(F.lit(CLOCK).alias("id"), "at")
            marks = passed.select(F.col("_id").alias("id"), F.col("_at").alias("at")).unionByName(newest)
            # a row that is not late may still be within reach of one that old
            _Seen(spark, f"{path}/seen", buckets, bound - pause if clock else None).upsert(marks, number)
        finally:
            batch.unpersist()

    return start_batches(messages, handle, checkpoint, every)


def read_side(spark: SparkSession, path: str, side: str, schema: T.StructType) -> DataFrame:
    """All rows that went to ``rows`` or to ``late``."""
    folders = [f"{path}/{side}/batch_id={n}" for n in numbered(spark, f"{path}/{side}", "batch_id")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
