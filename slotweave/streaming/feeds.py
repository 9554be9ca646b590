"""Sources, sinks and stateless or built-in stateful jobs on streams.

The stateless filters of ``operators.filters`` and ``operators.lookups.fan_out_topics`` take a
streaming DataFrame as it is. A slow sink slows the source down (rate options, triggers); rows
are never dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotweave.functions.scalars import instruction_type
from slotweave.operators.filters import relevant_to_program
from slotweave.operators.latest import latest_by
from slotweave.operators.topk import tracker_view
from slotweave.session import drop_folder, file_store, numbered, work_path
from slotweave.sources.keyed import KeyedTable


def read_feed(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = 100, bytes_per_trigger: str | None = None, **options
) -> DataFrame:
    """File feed. A micro-batch is bounded by files, or by bytes (like ``"1g"``) where files differ much in size."""
    bound = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.schema(schema).options(**options).option(*bound).parquet(path)


def write_feed(df: DataFrame, path: str, batch: str, batches: int) -> None:
    """Write a table as a file feed whose micro-batches are numbered from 0 by the column ``batch``: one job, a file for each.

    A file feed is read by modification time, so the files are stamped in the order of their numbers, a second apart.
    """
    spark = df.sparkSession
    df.repartitionById(batches, batch).write.partitionBy(batch).parquet(path)
    store, folder = file_store(spark, path)
    now = int(time.time())
    for part in store.listStatus(folder):
        name, _, number = part.getPath().getName().partition("=")
        if name == batch:
            for file in store.listStatus(part.getPath()):
                store.setTimes(file.getPath(), (now - batches + int(number)) * 1000, -1)


#: Whether a query runs batches without new rows. It takes the setting over when it starts.
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def start(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None, output_mode: str = "append", by_clock: bool = False
) -> StreamingQuery:
    """Append a stream to Parquet. ``every="100 milliseconds"`` publishes micro-batches at that
    pace; without it the query takes what is there in bounded batches and stops.

    ``by_clock``: the stream holds timers of the clock or state that expires by it. Such a query always has another batch
    without rows before it, so one that is to stop must start without these."""
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if every or not by_clock:
        return writer.format("parquet").start(path)
    spark = df.sparkSession
    before = spark.conf.get(IDLE)
    spark.conf.set(IDLE, "false")
    try:
        return writer.format("parquet").start(path)
    finally:
        spark.conf.set(IDLE, before)


def start_batches(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, output_mode: str = "append"
) -> StreamingQuery:
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(handle).start()


def drain(df: DataFrame, name: str, output_mode: str = "append", by_clock: bool = False) -> DataFrame:
    """Run a stream over everything its source holds and give the result as a table."""
    spark = df.sparkSession
    path = work_path(spark, name)
    start(df, path, work_path(spark, f"{name}-state"), output_mode=output_mode, by_clock=by_clock).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def batch_folder(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Batch handler that writes one folder per batch. A replayed batch overwrites its own folder,
    so the result holds every batch once."""

    def handle(df: DataFrame, batch_id: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


# --- duplicates -----------------------------------------------------------------------------------


def dedup_stream(messages: DataFrame, within: str | None = None, key: str = "message_id", order: str = "ts") -> DataFrame:
    """First of every id. Ids are remembered for ever, unless ``within`` bounds the state: then an id is remembered for that long
    in event time, and rows later than that behind the newest one are dropped by the watermark."""
    if within is None:
        return messages.dropDuplicates([key])
    return messages.withWatermark(order, within).dropDuplicatesWithinWatermark([key])


# --- upserts ----------------------------------------------------------------------------------------


def stream_upsert(df: DataFrame, log: str, checkpoint: str, key: str, order: list[str], every: str | None = None) -> StreamingQuery:
    """Keep a latest-state table from a feed: each micro-batch is reduced to one row per key and
    appended to ``log``. Nothing already written is rewritten."""
    return start_batches(df, batch_folder(log, lambda b: latest_by(b, [key], F.struct(*order))), checkpoint, every)


def stream_table(df: DataFrame, table: KeyedTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a latest-state table from a feed: each micro-batch becomes a version of ``table``, once, however often it is run."""
    return start_batches(df, lambda batch, n: table.upsert(batch, n), checkpoint, every)


def read_upserted(spark: SparkSession, log: str, schema: T.StructType, key: str, order: list[str], last: int | None = None) -> DataFrame:
    """Current rows of a log written by ``stream_upsert``, up to batch ``last``."""
    done = numbered(spark, f"{log}/compact", "upto")
    paths = [f"{log}/compact/upto={done[-1]}"] if done else []
    paths += [f"{log}/batch_id={n}" for n in numbered(spark, log, "batch_id") if not (done and n <= done[-1]) and (last is None or n <= last)]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return latest_by(rows, [key], F.struct(*order))


def compact_log(spark: SparkSession, log: str, schema: T.StructType, key: str, order: list[str]) -> None:
    """Fold all batches but the newest into one table beside them, then delete those batches. Safe while the stream runs.

    Only complete batches up to a fixed number are folded, so a batch that is being written or replayed is never touched; readers use
    the newest complete ``upto=<batch>`` and the batches after it.
    """
    batches = numbered(spark, log, "batch_id")[:-1]
    if not batches:
        return
    read_upserted(spark, log, schema, key, order, batches[-1]).write.mode("overwrite").parquet(f"{log}/compact/upto={batches[-1]}")
    for name, numbers in (("batch_id", batches), ("compact/upto", [n for n in numbered(spark, f"{log}/compact", "upto") if n < batches[-1]])):
        for n in numbers:
            drop_folder(spark, f"{log}/{name}={n}")


# --- live statistics ----------------------------------------------------------------------------------


KEEP_VERSIONS = 3  # of a live table: readers may still be at an earlier one


def _write_version(df: DataFrame, path: str, version: int) -> None:
    """A complete new version of a small table; a replayed batch overwrites its own, old ones go."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    for n in numbered(spark, path, "version"):
        if n <= version - KEEP_VERSIONS:
            drop_folder(spark, f"{path}/version={n}")


def live_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a streaming aggregate as a table: every micro-batch writes its full result to
    ``version=<batch>``; the last ``KEEP_VERSIONS`` stay. The result has one row per group, however long the feed runs."""
    return start_batches(df, lambda batch, n: _write_version(batch, path, n), checkpoint, every, "complete")


def read_live(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The last complete version."""
    versions = numbered(spark, path, "version")
    return spark.read.schema(schema).parquet(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], schema)


def live_daily(tx: DataFrame) -> DataFrame:
    """Running daily totals; use output mode ``complete`` or ``update``."""
    day = F.date_format(F.timestamp_seconds("block_time"), "yyyy-MM-dd")
    return tx.groupBy(day.alias("date")).agg(
        F.count("*").alias("transactions"),
        F.count(F.when(F.col("err").isNull(), 1)).alias("successful"),
        F.sum("fee").alias("fees"),
    )


def live_mix(tx: DataFrame, program: str) -> DataFrame:
    """Transactions of a program by type."""
    return relevant_to_program(tx, program).groupBy(instruction_type("instructions", program).alias("name")).agg(F.count("*").alias("value"))


def live_tracker(tx: DataFrame, program: str, path: str, checkpoint: str, keep: int = 100, every: str | None = None) -> StreamingQuery:
    """Newest ``keep`` transactions after every micro-batch, in a new folder ``version=<batch>``:
    the last version before it and the batch together hold all that can be among the newest."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = tracker_view(batch, program, keep).drop("shown")
        before = [n for n in numbered(spark, path, "version") if n < batch_id]
        if before:
            old = spark.read.schema(new.schema).parquet(f"{path}/version={before[-1]}")
            new = old.unionByName(new).orderBy(F.col("slot").desc(), F.col("idx").desc()).limit(keep)
        _write_version(new, path, batch_id)

    return start_batches(tx, handle, checkpoint, every)


def _counters(spark: SparkSession, path: str, kind: str) -> KeyedTable:
    schema = T.StructType.fromDDL(f"{kind} STRING, received BIGINT, errors BIGINT, published BIGINT, first BIGINT, last BIGINT, batch BIGINT")
    return KeyedTable(spark, path, schema, [kind], ["batch"], buckets=1)


def live_counters(df: DataFrame, kind: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Counters per kind so far, as a table at ``path``, and as observed metrics ``feed`` in the query's progress.

    A batch that is run again is counted once. A restart with another ``path`` counts from there on.
    """
    seen = df.observe("feed", F.count(F.lit(1)).alias("received"), F.count_if("error").alias("errors"))
    folds = [F.sum(c).alias(c) for c in ("received", "errors", "published")] + [F.min("first").alias("first"), F.max("last").alias("last")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        table = _counters(batch.sparkSession, path, kind)
        if batch_id <= table.manifest().batch:
            return
        new = batch.groupBy(kind).agg(
            F.count("*").alias("received"), F.count_if("error").alias("errors"), F.count_if("published").alias("published"),
            F.min("seconds").alias("first"), F.max("seconds").alias("last"),
        ).persist()  # a row per kind, used for its bucket and for the sums; observed once
        try:
            both = new.unionByName(table.read_buckets_of(new.select(kind)).drop("batch"))
            table.upsert(both.groupBy(kind).agg(*folds).withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)
        finally:
            new.unpersist()

    return start_batches(seen, handle, checkpoint, every)


def read_counters(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Totals and rates over all micro-batches."""
    elapsed = (F.col("last") - F.col("first")).cast("double")
    rate = F.when(elapsed > 0, F.col("received") / elapsed).otherwise(F.lit(0.0)).alias("per_second")
    return _counters(spark, path, kind).read().select(kind, "received", "errors", "published", rate)
