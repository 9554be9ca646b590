"""Running folds of keys over a feed, however many rows of one key a micro-batch holds.

A fold has two stages. Each micro-batch is cut into ranges of every key, which are folded in parallel by ``operators.ordered.running``; what a key
starts from is its carry, one small row of a ``KeyedTable``, that joins the ranges as the one before them all. No key's rows come
together in one task, and no Python runs.

A batch writes its rows to its own folder and then its carries. A batch that is replayed before its carries are in writes the same rows
again; one that is replayed after that is skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotweave.functions.scalars import base_penalty, severity
from slotweave.operators.ordered import FOLDS, running, seq_bucket
from slotweave.session import numbered
from slotweave.sources.keyed import KeyedTable
from slotweave.streaming.feeds import start_batches

#: The range a carry stands in: before all others.
FIRST = -(1 << 52)
CARRY = "_carry"


def fold_batch(
    rows: DataFrame, carries: DataFrame, keys: list[str], order: list[str], bucket: Column, folds: dict[str, tuple[str, Column]], before: bool = False
) -> DataFrame:
    """``rows`` with running ``folds`` that go on from ``carries`` (keys and one column per fold, or none of a key).

    Like ``running``, with ``count`` given as a sum of ones.
    """
    named = {n: f"{CARRY}_{n}" for n in folds}
    own = rows.withColumns({named[n]: value for n, (_, value) in folds.items()}).withColumn(CARRY, F.lit(False))
    first = carries.select(*keys, *[F.col(n).alias(c) for n, c in named.items()]).withColumn(CARRY, F.lit(True))
    both = own.unionByName(first, allowMissingColumns=True)
    place = F.when(F.col(CARRY), F.lit(FIRST)).otherwise(bucket).cast("bigint")
    made = running(both, keys, order, place, {n: (how, F.col(named[n])) for n, (how, _) in folds.items()}, before)
    return made.filter(~F.col(CARRY)).drop(CARRY, *named.values())


def fold_stream(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, folds: dict[str, tuple[str, Column]], shape: Callable[[DataFrame], DataFrame],
    path: str, checkpoint: str, before: bool = False, every: str | None = None, buckets: int = 64,
) -> StreamingQuery:
    """Run ``folds`` (name to sum/max/min and value) over a feed; ``shape`` makes the rows to keep, which go to ``path/rows``.

    Carries are in ``path/carries``. ``order`` is unique within a key and grows from micro-batch to micro-batch.
    """
    if any(how == "count" for how, _ in folds.values()):
        raise ValueError("give a count as a sum of ones")

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for totals, keys and rows
        try:
            folded(batch, number)
        finally:
            batch.unpersist()

    def folded(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        totals = batch.groupBy(*keys).agg(*[FOLDS[how](value).alias(n) for n, (how, value) in folds.items()])
        schema = T.StructType([*totals.schema.fields, T.StructField("batch", T.LongType())])
        carries = KeyedTable(spark, f"{path}/carries", schema, keys, ["batch"], buckets)
        if number <= carries.manifest().batch:
            return
        old = carries.read_buckets_of(batch.select(*keys).distinct())
        shape(fold_batch(batch, old, keys, order, bucket, folds, before)).write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")
        new = fold_totals(totals, old, keys, {n: how for n, (how, _) in folds.items()})
        carries.upsert(new.withColumn("batch", F.lit(number).cast("bigint")), number)

    return start_batches(df, handle, checkpoint, every)


def fold_totals(totals: DataFrame, carries: DataFrame, keys: list[str], folds: dict[str, str]) -> DataFrame:
    """Carries after a batch."""
    both = totals.unionByName(carries.select(*totals.columns))
    return both.groupBy(*keys).agg(*[FOLDS[how](n).cast(totals.schema[n].dataType).alias(n) for n, how in folds.items()])


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all complete batches."""
    folders = [f"{path}/rows/batch_id={n}" for n in numbered(spark, f"{path}/rows", "batch_id")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def advancing_slots(df: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, bucket: Column | None = None, every: str | None = None) -> StreamingQuery:
    """Rows whose slot exceeds every earlier slot of the same source; read them with ``read_rows``."""
    folds = {"_seen": ("max", F.col("slot"))}
    newer = F.col("_seen").isNull() | (F.col("slot") > F.col("_seen"))
    shape = lambda rows: rows.filter(newer).drop("_seen")
    return fold_stream(df, keys, order, seq_bucket(order[0]) if bucket is None else bucket, folds, shape, path, checkpoint, True, every)


def slashing_columns(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("total_severity", T.DecimalType(20, 1)), T.StructField("slashed", T.BooleanType()), T.StructField("penalty", T.LongType())])


def slashing(violations: DataFrame, threshold: float, path: str, checkpoint: str, order: list[str] = ["ts", "seq"], bucket: Column | None = None, every: str | None = None) -> StreamingQuery:
    """Violations with the running severity of their operator and the penalty due, as ``operators.staking.slashing`` gives them.

    ``bucket`` grows with ``order``; by default it is the hour of the first column.
    """
    ranges = F.floor(F.unix_timestamp(order[0]) / 3600) if bucket is None else bucket
    folds = {"_total": ("sum", F.coalesce(severity("violation").cast("decimal(20,1)"), F.lit(0).cast("decimal(20,1)")))}
    over = F.col("_total") >= F.lit(str(threshold)).cast("decimal(20,4)")
    wanted = slashing_columns(violations.schema)

    def shape(rows: DataFrame) -> DataFrame:
        made = rows.withColumns({"total_severity": F.col("_total").cast("decimal(20,1)"), "slashed": over, "penalty": F.when(over, base_penalty("violation")).otherwise(0).cast("bigint")})
        return made.select(*wanted.names)

    return fold_stream(violations, ["operator"], order, ranges, folds, shape, path, checkpoint, every=every)
