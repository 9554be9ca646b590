"""Streaming forms, run over everything the event feed holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave import fixtures as X
from slotweave.operators import filters as Fi
from slotweave.operators.lookups import fan_out_topics
from slotweave.operators.ordered import seq_bucket
from slotweave.operators.stats import daily_stats
from slotweave.plans.oracle_views import oracle
from slotweave.plans.reads import LATEST, MINE, PROGRAM, type_sql
from slotweave.plans.registry import ORACLES, query
from slotweave.plans.relational import BLOCK_STATE, BLOCKS_SQL
from slotweave.session import work_path
from slotweave.sources.keyed import KeyedTable
from slotweave.streaming import feeds, folds, seen, stateful


FEEDS: dict[tuple, str] = {}


def events_feed(v, rows: int = 1_000_000):
    """The event table as a feed of up to ``rows`` rows a micro-batch, four micro-batches at least, so that state crosses them.

    One job writes it, once for each session and data folder. Rows without an id come first.
    """
    key = (v.spark.sparkContext.applicationId, v.sf_dir, rows)
    events = v.base("events")
    if key in FEEDS:
        return feeds.read_feed(v.spark, FEEDS[key], events.schema, 1, recursiveFileLookup="true")
    path = work_path(v.spark, "event-feed")
    parts = max(4, -(-events.count() // rows))
    cuts = sorted(set(events.stat.approxQuantile("event_id", [k / parts for k in range(1, parts)], 0.1 / parts)))
    batch = sum((F.coalesce(F.col("event_id") >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    feeds.write_feed(events.withColumn("batch", batch), path, "batch", parts)
    FEEDS[key] = path
    return feeds.read_feed(v.spark, path, events.schema, 1, recursiveFileLookup="true")


@query("t1_assemble_blocks_stream", oracle("v_slot_messages", BLOCKS_SQL, st=BLOCK_STATE))
def assemble(v):
    return feeds.drain(stateful.assemble_blocks_stream(X.slot_messages(events_feed(v))), "blocks")


@query(
    "t2_filtered_feed",
    oracle("v_account_updates", "SELECT seq, pubkey, owner, lamports FROM v_account_updates WHERE owner = 'purchase'"),
)
def filtered(v):
    rows = Fi.filter_account_updates(X.account_updates(events_feed(v)), "", "purchase").select("seq", "pubkey", "owner", "lamports")
    return feeds.drain(rows, "filtered")


@query("t3_dedup_stream", oracle("v_messages", "SELECT DISTINCT message_id FROM v_messages"))
def dedup(v):
    return feeds.drain(feeds.dedup_stream(X.messages(events_feed(v)), within=None).select("message_id"), "dedup")


@query("t3_dedup_within_watermark", oracle("v_messages", "SELECT DISTINCT message_id FROM v_messages"))
def dedup_bounded(v):
    # copies of a message are minutes apart in this feed, so a day of memory is exact
    return feeds.drain(feeds.dedup_stream(X.messages(events_feed(v)), within="1 day").select("message_id"), "dedup-bounded")


@query("t4_advancing_slots_stream", ORACLES["w5_advancing_slots"])
def advancing(v):
    rows = X.account_updates(events_feed(v)).select("seq", "owner", "slot")
    return feeds.drain(stateful.advancing_slots_stream(rows, "owner", ["seq"]), "advancing")


@query(
    "t5_micro_batches",
    oracle("v_account_updates", "SELECT seq, pubkey, slot FROM v_account_updates"),
)
def micro_batches(v):
    rows = X.account_updates(events_feed(v)).select("seq", "pubkey", "slot")
    return feeds.drain(rows, "micro-batches")


@query(
    "t4_advancing_slots_folded",
    ORACLES["w5_advancing_slots"],
)
def advancing_folded(v):
    """Ranges of 100 rows, folded in parallel; a source's greatest slot is carried from batch to batch."""
    rows = X.account_updates(events_feed(v)).select("seq", "owner", "slot")
    path = work_path(v.spark, "advancing-fold")
    folds.advancing_slots(rows, ["owner"], ["seq"], path, work_path(v.spark, "advancing-state"), seq_bucket(width=100)).awaitTermination()
    return folds.read_rows(v.spark, path, rows.schema)


@query("t11_slashing_folded", ORACLES["w2_slashing"])
def slashing_folded(v):
    rows = X.violations(events_feed(v))
    path = work_path(v.spark, "slashing-fold")
    folds.slashing(rows, 5.0, path, work_path(v.spark, "slashing-state")).awaitTermination()
    made = folds.read_rows(v.spark, path, folds.slashing_columns(rows.schema))
    return made.select("operator", "seq", F.col("total_severity").cast("double").alias("total_severity"), "slashed", "penalty")


@query(
    "t5_batches_by_count",
    oracle("v_account_updates", """
        SELECT seq, lane, (n - 1) // 50 AS batch_id, CASE WHEN (n - 1) // 50 < total // 50 THEN 'count' ELSE 'end' END AS closed_by
        FROM (SELECT seq, seq % 3 AS lane, row_number() OVER (PARTITION BY seq % 3 ORDER BY seq) AS n, count(*) OVER (PARTITION BY seq % 3) AS total
              FROM v_account_updates)"""),
)
def batches_by_count(v):
    """Batches of 50 in each of three lanes, over several micro-batches, and what is open at the end of the feed."""
    rows = X.account_updates(events_feed(v)).select("seq", (F.col("seq") % 3).alias("lane"))
    made = stateful.micro_batches(rows, "lane", ["seq"], 50, "1 day")
    checkpoint, path = work_path(v.spark, "lanes-state"), work_path(v.spark, "lanes")
    feeds.start(made, path, checkpoint, by_clock=True).awaitTermination()
    closed = v.spark.read.schema(made.schema).parquet(path)
    return closed.unionByName(stateful.open_batches(v.spark, checkpoint, made.schema, "lane")).select("seq", "lane", "batch_id", "closed_by")


@query("t3_dedup_expiring", oracle("v_messages", "SELECT message_id, min(seq) AS seq FROM v_messages GROUP BY message_id"))
def dedup_expiring(v):
    # ids are remembered for an hour by the clock: longer than this feed takes
    rows = stateful.dedup_expiring(X.messages(events_feed(v)).select("message_id", "seq"), "1 hour")
    return feeds.drain(rows, "dedup-expiring", by_clock=True)


@query("t3_dedup_event_time", oracle("v_messages", "SELECT message_id, min(seq) AS seq, 0 AS late FROM v_messages GROUP BY message_id"))
def dedup_event_time(v):
    """A day of memory is exact here; no row of this feed is late, and the number of late ones is part of the result."""
    rows, path = X.messages(events_feed(v)).select("message_id", "seq", "ts"), work_path(v.spark, "dedup-time")
    seen.dedup_by_event_time(rows, "1 DAY", path, work_path(v.spark, "dedup-time-state"), buckets=8).awaitTermination()
    late = seen.read_side(v.spark, path, "late", rows.schema).agg(F.count("*").cast("int").alias("late"))
    passed = seen.read_side(v.spark, path, "rows", rows.schema).select("message_id", "seq")
    return passed.withColumn("late", F.lit(late.first()[0]))


@query(
    "t8_keyed_table",
    oracle("v_account_updates", "SELECT pubkey, lamports, slot, seq FROM cur", cur=LATEST),
)
def keyed_table(v):
    """The latest state as a table of key-hash buckets, merged while the feed goes on."""
    order = ["slot", "write_version", "seq"]
    rows = X.account_updates(events_feed(v)).select("pubkey", "lamports", *order)
    table = KeyedTable(v.spark, work_path(v.spark, "accounts"), rows.schema, ["pubkey"], order, buckets=8, fan=2)
    feeds.stream_table(rows, table, work_path(v.spark, "accounts-state")).awaitTermination()
    return table.read().select("pubkey", "lamports", "slot", "seq")


@query("t7_fan_out_stream", ORACLES["t7_fan_out_topics"])
def fan_out(v):
    rows = fan_out_topics(X.messages(events_feed(v)).drop("ts", "source"), ["all", "click", "signup"])
    return feeds.drain(rows, "topics")


@query("t8_stream_upsert", oracle("v_account_updates", "SELECT pubkey, lamports, slot, seq FROM cur", cur=LATEST))
def upsert(v):
    order = ["slot", "write_version", "seq"]
    log = work_path(v.spark, "log")
    rows = X.account_updates(events_feed(v)).select("pubkey", "lamports", *order)
    feeds.stream_upsert(rows, log, work_path(v.spark, "log-state"), "pubkey", order).awaitTermination()
    return feeds.read_upserted(v.spark, log, rows.schema, "pubkey", order).select("pubkey", "lamports", "slot", "seq")


def _transactions(v):
    """Orders as a feed; the item tables are static and joined in."""
    orders = feeds.read_feed(v.spark, f"{v.sf_dir}/orders.parque[t]", v.base("orders").schema)
    return X.transactions(orders, v.base("lineitem"), v.base("part"))


@query(
    "t9_live_daily",
    oracle("v_transactions", """
        SELECT strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') AS date, count(*) AS transactions,
               count(*) FILTER (err IS NULL) AS successful, CAST(sum(fee) AS BIGINT) AS fees
        FROM v_transactions GROUP BY 1"""),
)
def live_daily(v):
    totals = feeds.live_daily(_transactions(v))
    path = work_path(v.spark, "daily")
    feeds.live_table(totals, path, work_path(v.spark, "daily-state")).awaitTermination()
    return feeds.read_live(v.spark, path, totals.schema)


@query(
    "t9_live_mix",
    oracle("v_transactions", "SELECT type AS name, count(*) AS value FROM typed WHERE " + MINE + " GROUP BY type", typed=type_sql(PROGRAM)),
)
def live_mix(v):
    totals = feeds.live_mix(_transactions(v), PROGRAM)
    path = work_path(v.spark, "mix")
    feeds.live_table(totals, path, work_path(v.spark, "mix-state")).awaitTermination()
    return feeds.read_live(v.spark, path, totals.schema)


@query(
    "t9_live_tracker",
    oracle("v_transactions", f"""
        SELECT signature, slot, type AS instruction_type FROM typed WHERE {MINE} ORDER BY slot DESC, idx DESC LIMIT 100""",
        typed=type_sql(PROGRAM)),
)
def live_tracker(v):
    rows = _transactions(v).select("signature", "slot", "idx", "program_ids", "accounts", "instructions")
    path = work_path(v.spark, "tracker")
    feeds.live_tracker(rows, PROGRAM, path, work_path(v.spark, "tracker-state")).awaitTermination()
    schema = rows.withColumn("instruction_type", F.lit("")).schema
    return feeds.read_live(v.spark, path, schema).select("signature", "slot", "instruction_type")


@query(
    "t9_live_tracker_stats",
    oracle("v_transactions", f"""
        SELECT strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') AS date, count(*) AS transactions,
               count(*) FILTER (err IS NULL) / count(*) * 100 AS success_rate, round(CAST(sum(fee) AS DOUBLE) / 1e9, 6) AS fees
        FROM (SELECT * FROM typed WHERE {MINE} ORDER BY slot DESC, idx DESC LIMIT 100) GROUP BY 1""", typed=type_sql(PROGRAM)),
)
def live_tracker_stats(v):
    """Daily success rate and fees over the newest 100 of one program, as the live view shows them."""
    rows = _transactions(v).select("signature", "slot", "idx", "program_ids", "accounts", "instructions", "block_time", "err", "fee")
    path = work_path(v.spark, "tracker-stats")
    feeds.live_tracker(rows, PROGRAM, path, work_path(v.spark, "tracker-stats-state")).awaitTermination()
    return daily_stats(feeds.read_live(v.spark, path, rows.withColumn("instruction_type", F.lit("")).schema))


@query("t6_evict_rooted_stream", oracle("v_slot_messages", BLOCKS_SQL, st=BLOCK_STATE))
def evict(v):
    """Blocks as assembled with eviction on: state of rooted slots far behind is dropped."""
    return feeds.drain(stateful.assemble_blocks_stream(X.slot_messages(events_feed(v)), keep_slots=1000), "evicting")


@query(
    "t10_live_counters",
    oracle("v_slot_messages", """
        SELECT kind, count(*) AS received, count(*) FILTER (seq % 11 = 0) AS errors, count(*) FILTER (seq % 11 <> 0) AS published,
               CASE WHEN max(slot) > min(slot) THEN round(count(*) / (max(slot) - min(slot)), 9) ELSE 0 END AS per_second
        FROM v_slot_messages GROUP BY kind"""),
)
def counters(v):
    flagged = X.slot_messages(events_feed(v)).select(
        "kind", (F.col("seq") % 11 == 0).alias("error"), (F.col("seq") % 11 != 0).alias("published"), F.col("slot").alias("seconds")
    )
    path = work_path(v.spark, "counters")
    feeds.live_counters(flagged, "kind", path, work_path(v.spark, "counters-state")).awaitTermination()
    return feeds.read_counters(v.spark, path, "kind").withColumn("per_second", F.round("per_second", 9))


@query("t11_slashing_stream", ORACLES["w2_slashing"])
def slashing(v):
    rows = feeds.drain(stateful.slashing_stream(X.violations(events_feed(v)), 5.0), "slashing")
    return rows.select("operator", "seq", F.col("total_severity").cast("double").alias("total_severity"), "slashed", "penalty")
