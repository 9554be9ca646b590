"""State of many keys: calls and values by bucket, results as of each key alone."""

import pytest
from pyspark.sql import functions as F

from slotweave.operators import staking
from slotweave.operators.assembly import assemble_blocks, block_entries
from slotweave.streaming import feeds, stateful
from tests.conftest import rows

KEYS = 3000


def run(spark, tmp_path, table, job):
    """``job`` over the table in three micro-batches by seq; its rows, and the most values its state held."""
    table = table.persist()
    for i in range(3):
        part = table.filter(F.col("seq") >= KEYS * 2 * i).filter(F.col("seq") < KEYS * 2 * (i + 1))
        (part if i else part.unionByName(table.filter("seq is null"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = job(feeds.read_feed(spark, str(tmp_path / "in"), table.schema, 1))
    query = feeds.start(made, str(tmp_path / "o"), str(tmp_path / "s"), by_clock=True)
    query.awaitTermination()
    held = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    return spark.read.schema(made.schema).parquet(str(tmp_path / "o")), max(held)


def same(got, want):
    cols = sorted(want.columns)
    assert rows(got, *cols) == rows(want, *cols) and want.count() > 0


def messages(spark):
    """Slots in whose messages every whole number may be NULL, and numbers that a float can't hold."""
    seq = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("entry", "metadata", "status")]), (F.xxhash64("id") % 3 + 3).cast("int") % 3 + 1)
    some = lambda c, n: F.when(F.xxhash64("id", F.lit(n)) % 4 != 0, c)
    big = F.lit(2**53 + 1) + seq
    slot = F.when(seq % 97 != 5, F.expr(f"id % {KEYS}"))
    return spark.range(KEYS * 6).select(
        seq.alias("seq"), slot.alias("slot"), kind.alias("kind"), F.when(kind == "status", F.when(seq % 5 > 0, "rooted").otherwise("confirmed")).alias("status"),
        F.when(kind == "status", some(big, 1)).alias("parent"), F.when(kind == "metadata", some(big, 2)).alias("parent_slot"),
        F.when(kind == "metadata", some(F.concat(F.lit("h"), seq.cast("string")), 3)).alias("blockhash"), F.when(kind == "metadata", some(big, 4)).alias("block_time"),
        F.when(kind == "metadata", some(seq, 5)).alias("block_height"), F.when(kind == "metadata", some(big, 6)).alias("transaction_count"),
        F.when(kind == "metadata", some(seq, 7)).alias("entry_count"), F.when(kind == "entry", some(big, 8)).alias("entry_index"),
        F.when(kind == "entry", some(seq, 9)).alias("executed_tx"),
    )


def test_slashing_of_many_operators(spark, tmp_path):
    kinds = F.array(*[F.lit(k) for k in ("DoubleVote", "LowUptime", "other")])
    table = spark.range(KEYS * 6).select(
        F.when(F.col("id") % 101 != 3, F.concat(F.lit("u"), (F.col("id") % KEYS).cast("string"))).alias("operator"), F.timestamp_seconds("id").alias("ts"),
        F.col("id").alias("seq"), F.element_at(kinds, (F.col("id") % 3 + 1).cast("int")).alias("violation"), F.when(F.col("id") % 2 == 0, F.col("id") + F.lit(2**53)).alias("note"),
    )
    got, held = run(spark, tmp_path, table, lambda v: stateful.slashing_stream(v, 5.0))
    cols = ["operator", "seq", "note", "slashed", "penalty", F.col("total_severity").cast("double")]
    assert rows(got, *cols) == rows(staking.slashing(table, 5.0), *cols)
    assert held <= stateful.BUCKETS


def test_entries_of_many_slots(spark, tmp_path):
    table = messages(spark)
    got, held = run(spark, tmp_path, table, lambda m: stateful.block_entries_stream(m, 2))
    text = lambda d: d.withColumn("entries", F.col("entries").cast("string"))
    same(text(got), text(block_entries(table, 2)))
    assert held <= stateful.LANES * (1 + KEYS // stateful.LANES**2)


@pytest.mark.parametrize("keep", [None, 10_000])
def test_blocks_of_many_slots(spark, tmp_path, keep):
    table = messages(spark).filter("slot is not null" if keep else "true")
    got, held = run(spark, tmp_path, table, lambda m: stateful.assemble_blocks_stream(m, keep))
    same(got, assemble_blocks(table))
    calls = stateful.LANES * (1 + KEYS // stateful.LANES**2)
    assert held <= calls * (1 if keep is None else 7)  # a bucket's value, and at most one timer (two entries) a micro-batch


def test_ids_of_many_messages(spark, tmp_path):
    table = spark.range(KEYS * 6).select(F.when(F.col("id") % 89 != 4, F.concat(F.lit("m"), (F.col("id") % (KEYS * 3)).cast("string"))).alias("message_id"), F.col("id").alias("seq"))
    got, held = run(spark, tmp_path, table, lambda m: stateful.dedup_expiring(m, "1 hour"))
    same(got, table.groupBy("message_id").agg(F.min("seq").alias("seq")))
    assert held <= 3 * stateful.BUCKETS  # a value for each micro-batch
