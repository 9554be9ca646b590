"""Sources, layouts, filters, latest state and lookups on small frames."""

import json
import os

import pytest
from pyspark.sql import functions as F

from slotweave.operators import filters as Fi
from slotweave.operators import latest, lookups, staking, stats, topk
from slotweave.operators.assembly import assemble_blocks
from slotweave.session import shared_root
from slotweave.sources import rpc, tables
from tests.conftest import rows


def accounts(spark, n=200):
    return tables.normalize_versions("accounts", spark.range(n).select(
        F.format_string("k%03d", "id").alias("pubkey"), (F.col("id") * 10).alias("lamports"), F.lit("o").alias("owner"),
        F.col("id").alias("slot"), F.lit(1).cast("bigint").alias("write_version"),
    ))


def files(path):
    return [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_roll_by_bytes(spark, tmp_path):
    """Rows of very different sizes: no file is larger than the limit, and no setting of the session is touched meanwhile."""
    small = spark.range(0, 200_000, 1, 4).select("id", F.lit("s").alias("text"))
    large = spark.range(0, 6000, 1, 2).select("id", F.sha2(F.col("id").cast("string"), 512).alias("h"))
    large = large.select("id", F.concat(*[F.sha2(F.concat("h", F.lit(str(k))), 512) for k in range(12)]).alias("text"))
    shared_root(spark)
    before = {r[0]: r[1] for r in spark.sql("SET").collect()}
    for name, df in (("mixed", small.unionByName(large)), ("by", small.unionByName(large).withColumn("part", F.col("id") % 2))):
        path = tmp_path / name
        tables.write_table(df, str(path), max_file_mb=1, partition_by=["part"] if name == "by" else None)
        sizes = [f.stat().st_size for f in path.rglob("*.parquet")]
        assert len(sizes) >= 4 and max(sizes) <= 1 << 20
        assert spark.read.parquet(str(path)).count() == 206_000
    assert {r[0]: r[1] for r in spark.sql("SET").collect()} == before
    assert tables.rows_per_file(small.limit(0), 1 << 20) > 1 << 30 and tables.rows_per_file(large, 1) == 1


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "a")
    tables.write_table(accounts(spark).coalesce(1), path, max_records=50)
    assert len(files(path)) == 4 and all(f.endswith(".snappy.parquet") for f in files(path))
    back = tables.read_table(spark, "accounts", path)
    assert back.schema["lamports"].dataType.simpleString() == "decimal(20,0)"
    assert rows(back, "pubkey", "lamports") == rows(accounts(spark), "pubkey", "lamports")


def test_write_by_size_merges_small_partitions(spark, tmp_path):
    path = str(tmp_path / "a")
    tables.write_table(accounts(spark).repartition(50), path, max_file_mb=64)
    assert len(files(path)) == 1


def test_slot_range_reads_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "b")
    tables.write_bucketed(accounts(spark), path, width=10)
    got = tables.read_bucketed(spark, "accounts", path, 35, 61, width=10)
    assert rows(got, "slot") == [(s,) for s in range(35, 62)]
    assert "PartitionFilters: [isnotnull(slot_bucket" in plan(got)
    assert len(got.inputFiles()) and got.select(F.input_file_name()).distinct().count() <= 4
    raw = spark.read.parquet(path)
    assert "PartitionFilters: []" in plan(raw.filter("slot between 35 and 61"))
    assert rows(Fi.slot_range(raw, 35, 61, width=10), "slot") == rows(got, "slot")


def test_read_tables(spark, tmp_path):
    tables.write_table(accounts(spark, 3), str(tmp_path / "accounts"))
    assert list(tables.read_tables(spark, str(tmp_path), "accounts")) == ["accounts"]
    assert tables.read_tables(spark, str(tmp_path), "accounts", {"accounts": None}) == {}
    with pytest.raises(ValueError):
        tables.read_tables(spark, str(tmp_path), "accounts,nope")


def test_hot_cold(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9), ("c", 3)], "pubkey string, slot bigint")
    hot, cold = tables.split_hot_cold(df, 5)
    old = cold.unionByName(spark.createDataFrame([("b", 2)], df.schema))
    assert rows(tables.read_hot_cold(hot, old, "pubkey")) == [("a", 1), ("b", 9), ("c", 3)]


def test_rpc_text_and_export(spark, tmp_path):
    spark.createDataFrame([("{}",), ("x",)], "body string").coalesce(1).write.text(str(tmp_path / "t"))
    assert rows(rpc.read_rpc_json(spark, str(tmp_path / "t"))) == [("x",), ("{}",)]
    rpc.export_json(spark.range(2), str(tmp_path / "j"), "now")
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(d["id"] for d in docs) == [0, 1] and {d["exportedAt"] for d in docs} == {"now"}


def test_account_selectors(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "pubkey string, owner string")
    pick = lambda *a: rows(Fi.select_accounts(df, *a), "pubkey")
    assert pick(None) == [] and pick([]) == [] and pick(["*"]) == [("a",), ("b",), ("c",)]
    assert pick(["a"], ["z"]) == [("a",), ("c",)]
    long = [f"n{i}" for i in range(2000)]
    assert pick([*long, "a", "a"], [*long, "z", "x"]) == [("a",), ("c",)]
    assert rows(Fi.filter_account_updates(df), "pubkey") == [("a",), ("b",), ("c",)]
    assert rows(Fi.filter_account_updates(df, "a,b", "y"), "pubkey") == [("b",)]


def test_transaction_selectors(spark):
    df = spark.createDataFrame([(1, True, ["a"]), (2, False, ["b", "c"]), (3, False, [])], "id int, is_vote boolean, accounts array<string>")
    pick = lambda *a: [r[0] for r in rows(Fi.select_transactions(df, *a), "id")]
    assert pick(None) == [] and pick([]) == [] and pick(["*"]) == [1, 2, 3]
    assert pick(["all_votes"]) == [1] and pick([], True) == [1] and pick(["c"]) == [2] and pick(["c"], True) == [1, 2]


@pytest.mark.parametrize("tie,want", [("write_version", 1), ("arrival", 2)])
def test_upsert_ties(spark, tie, want):
    schema = "pubkey string, slot bigint, write_version bigint, seq bigint, v int"
    updates = spark.createDataFrame([("a", 5, 9, 1, 1), ("a", 5, 3, 2, 2), ("a", 4, 99, 3, 3)], schema)
    base = spark.createDataFrame([("a", 5, 3, 7), ("b", 1, 1, 8)], "pubkey string, slot bigint, write_version bigint, v int")
    assert rows(latest.upsert_accounts(base, updates, tie), "pubkey", "v") == [("a", want), ("b", 8)]


def test_upsert_does_not_depend_on_partitioning(spark, views):
    want = rows(latest.upsert_accounts(None, views.account_updates), "pubkey", "seq")
    for n in (1, 5):
        mixed = views.account_updates.orderBy(F.rand(n)).repartition(n)
        assert rows(latest.upsert_accounts(None, mixed), "pubkey", "seq") == want


def test_mentions(spark):
    tx = spark.createDataFrame([("s", ["a", "b", "a"], [1, 0, 2])], "signature string, accounts array<string>, roles array<int>")
    assert rows(lookups.build_mentions(tx, "roles")) == [("s", "a", True, True), ("s", "b", False, False)]
    assert rows(lookups.build_mentions(tx)) == [("s", "a", True, True), ("s", "b", False, True)]


def test_watchlist_misses_stay(spark):
    watch = spark.createDataFrame([("1", "account", "a"), ("2", "account", "q"), ("3", "transaction", "s"), ("4", "token", "a")], "id string, type string, pubkey string")
    acc = spark.createDataFrame([("a", 2_000_000_000)], "pubkey string, lamports bigint")
    tx = spark.createDataFrame([("s", 5)], "signature string, slot bigint")
    tok = spark.createDataFrame([("a", "m1"), ("a", "m2")], "owner string, mint string")
    got = lookups.enrich_watchlist(watch, acc, tx, tok)
    assert rows(got, "id", "error", "key_data") == [
        ("1", False, "2.0000 SOL"), ("2", True, "No data"), ("3", False, "Slot: 5"), ("4", False, "2 tokens"),
    ]


def test_chain(spark):
    schema = "slot bigint, parent_slot bigint, blockhash string, parent_blockhash string, block_height bigint"
    blocks = spark.createDataFrame([(1, None, "a", None, 1), (2, 1, "b", "a", 2), (4, 2, "c", "x", 9), (6, 5, "d", "q", 10)], schema)
    assert rows(lookups.chain_link_check(blocks), "slot", "parent_found", "hash_ok", "height_ok") == [
        (1, False, False, False), (2, True, True, True), (4, True, False, False), (6, False, False, False),
    ]
    assert rows(lookups.contiguous_blocks(blocks, 3), "slot") == [(4,), (6,)]
    assert rows(lookups.contiguous_blocks(blocks, 3, True), "slot", "blockhash") == [(4, "c"), (5, None), (6, "d")]
    assert topk.latest_block(blocks).first().slot == 6
    assert topk.latest_block(blocks.limit(0)).count() == 0


def test_retain_and_page(spark):
    slots = spark.range(30).withColumnRenamed("id", "slot")
    assert topk.retain_latest_slots(slots, 30, 5).count() == 30
    assert rows(topk.retain_latest_slots(slots, 29, 5)) == [(s,) for s in range(25, 30)]
    many = spark.range(500).withColumnRenamed("id", "slot")
    assert topk.page(many, "slot").count() == 10 and topk.page(many, "slot", 1000).count() == 500
    with pytest.raises(ValueError):
        topk.page(many, "slot", 101, max_limit=100)
    twice = slots.unionByName(slots)
    assert topk.retain_latest_slots(twice, 30, 5).count() == 60 and topk.retain_latest_slots(twice, 29, 5).count() == 10
    assert [r.slot for r in topk.page(many, "slot", 3, before=9, after=2).collect()] == [8, 7, 6]


def test_rewards(spark):
    current = spark.createDataFrame([("a", 1000)], "operator string, amount bigint")
    pending = spark.createDataFrame([("a", 509), ("b", 7)], "operator string, amount bigint")
    paid, left = staking.distribute_rewards(current, pending)
    assert rows(paid) == [("a", 1509, 150, 1359)]
    assert rows(left) == [("b", 7)]


def test_supermajority_needs_more_than_two_thirds(spark):
    ops = spark.createDataFrame([("a", 2, True), ("b", 1, True), ("c", 5, False)], "operator string, stake bigint, is_active boolean")
    votes = spark.createDataFrame([("h", "a"), ("h", "a"), ("i", "a"), ("i", "b"), ("j", "c"), ("k", "nobody")], "block_hash string, validator string")
    assert rows(staking.supermajority(votes, ops), "block_hash", "vote_stake", "confirmed") == [
        ("h", 2, False), ("i", 3, True), ("j", 5, True), ("k", 0, False),
    ]
    assert rows(staking.supermajority(votes, ops, True), "block_hash", "confirmed") == [("h", False), ("i", True)]


@pytest.mark.parametrize("n,need,threshold,ready", [(3, 3, 0.66, True), (2, 3, 0.66, False), (3, 3, 1.5, False), (0, 3, 0.1, False)])
def test_consensus_ready(spark, n, need, threshold, ready):
    ops = spark.range(n).select(F.col("id").cast("string").alias("operator"))
    assert staking.consensus_ready(ops.unionByName(ops), need, threshold).first() == (n, ready)


def test_health(spark):
    data = [("a", "healthy"), ("a", "healthy"), ("b", "healthy"), ("b", "unhealthy"), ("c", "degraded"), ("d", "unhealthy")]
    checks = spark.createDataFrame(data, "service string, status string")
    services = spark.createDataFrame([(s,) for s in "abcde"], "service string")
    assert rows(stats.health_rollup(checks, services), "service", "status") == [
        ("a", "healthy"), ("b", "degraded"), ("c", "degraded"), ("d", "unhealthy"), ("e", "healthy"),
    ]


def test_rates_without_elapsed_time(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("b", 7)], "kind string, s bigint")
    assert rows(stats.ingest_rates(df, "kind", "s")) == [("a", 1, 0.0), ("b", 2, 1.0)]


def test_empty_inputs(spark, views):
    tx, acc = views.transactions.limit(0), views.account_updates.limit(0)
    assert stats.indexer_state(acc, tx).first() == (None, 0, 0)
    assert stats.daily_stats(tx).count() == 0
    assert staking.total_active_stake(views.operators.limit(0)).first().total_stake == 0
    assert rows(stats.table_counts({"accounts": acc, "transactions": tx})) == [("accounts", 0), ("transactions", 0)]


def test_block_assembly_rules(spark):
    schema = (
        "slot bigint, seq bigint, kind string, status string, parent bigint, parent_slot bigint, blockhash string, block_time bigint, "
        "block_height bigint, transaction_count bigint, entry_count bigint, executed_tx bigint"
    )
    e = lambda slot, seq, tx: (slot, seq, "entry", None, None, None, None, None, None, None, None, tx)
    s = lambda slot, seq, st, parent: (slot, seq, "status", st, parent, None, None, None, None, None, None, None)
    m = lambda slot, seq, bh, parent, n: (slot, seq, "metadata", None, None, parent, bh, 1, 2, 3, n, None)
    data = [
        s(1, 1, "confirmed", 0), e(1, 2, 5), s(1, 3, "rooted", 9), e(1, 4, 6), m(1, 5, "x", None, 40), m(1, 6, "y", 7, None),
        s(1, 7, "confirmed", 0), m(1, 8, "z", None, 1), e(2, 9, 1), s(2, 10, "rooted", 1),
    ]
    got = assemble_blocks(spark.createDataFrame(data, schema).repartition(3), F.expr("seq div 2"))
    assert rows(got, "seq", "slot", "parent_slot", "blockhash", "entry_count", "executed_tx") == [
        (10, 2, None, None, 1, 1), (3, 1, 0, None, 1, 5), (5, 1, 0, "x", 40, 11), (6, 1, 7, "y", 2, 11),
    ]
