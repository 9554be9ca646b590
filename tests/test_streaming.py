"""Stream = batch: each stream job over at least three micro-batches equals its batch form."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from slotweave import fixtures as X
from slotweave.operators import filters, latest, lookups, ordered, staking, stats, topk
from slotweave.operators.assembly import assemble_blocks, block_entries
from slotweave.plans.blocks import entry_texts, reward_texts
from slotweave.session import numbered
from slotweave.streaming import feeds, folds, monitor, seen, stateful
from tests.conftest import SF, rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    for i in range(3):
        events.filter(F.floor(F.col("event_id") / 334) == i).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def feed(spark, events, folder):
    return feeds.read_feed(spark, folder, events.schema, files_per_trigger=1)


def same(stream, batch):
    cols = sorted(batch.columns)
    assert rows(stream, *cols) == rows(batch, *cols)


def test_filter_and_fan_out(feed, events):
    job = lambda e: filters.filter_account_updates(X.account_updates(e), "acct1,acct2", None)
    same(feeds.drain(job(feed), "f"), job(events))
    job = lambda e: lookups.fan_out_topics(X.messages(e), ["click"])
    same(feeds.drain(job(feed), "f"), job(events))


@pytest.mark.parametrize("within", [None, "2 days"])
def test_dedup(feed, events, within):
    got = feeds.drain(feeds.dedup_stream(X.messages(feed), within), "d")
    assert rows(got, "message_id") == rows(lookups.dedup_messages(X.messages(events)), "message_id")


@pytest.mark.parametrize("keep", [None, 1000])
def test_block_assembly(feed, events, keep):
    got = feeds.drain(stateful.assemble_blocks_stream(X.slot_messages(feed), keep), "b")
    same(got, assemble_blocks(X.slot_messages(events)))


def test_block_assembly_forgets_old_rooted_slots(spark, tmp_path):
    """A rooted slot far behind the newest one starts anew; one that is close keeps its state."""
    schema = X.slot_messages(spark.read.parquet(f"{SF}/events.parquet")).schema
    msg = lambda slot, seq, kind, status=None, tx=None: tuple(
        {"slot": slot, "seq": seq, "kind": kind, "status": status, "executed_tx": tx}.get(c) for c in schema.names
    )
    batches = [
        [msg(0, 1, "entry", tx=5), msg(0, 2, "status", "rooted"), msg(95, 3, "entry", tx=7), msg(95, 4, "status", "rooted")],
        [msg(100, 5, "entry", tx=1)], [msg(101, 6, "entry", tx=1)],
        [msg(0, 7, "status", "rooted"), msg(95, 8, "status", "rooted")],
    ]
    path = str(tmp_path / "in")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    source = feeds.read_feed(spark, path, schema, 1)
    got = feeds.drain(stateful.assemble_blocks_stream(source, 10), "evict")
    assert rows(got, "seq", "slot", "executed_tx") == [(2, 0, 5), (4, 95, 7), (8, 95, 7)]


def test_advancing_slots(feed, events):
    got = feeds.drain(stateful.advancing_slots_stream(X.account_updates(feed), "owner", ["seq"]), "a")
    same(got, ordered.advancing_slots(X.account_updates(events), ["owner"], ["seq"], ordered.seq_bucket()))


def test_slashing(feed, events):
    got = feeds.drain(stateful.slashing_stream(X.violations(feed), 5.0), "s")
    want = staking.slashing(X.violations(events), 5.0)
    cols = ["operator", "seq", "slashed", "penalty", F.col("total_severity").cast("double")]
    assert rows(got, *cols) == rows(want, *cols)


def test_slashing_survives_unknown_violations(spark, tmp_path):
    odd = [("a", 1, "DoubleProposal"), ("a", 2, "unknown"), ("a", 3, None)]
    df = spark.createDataFrame(odd, "operator string, seq bigint, violation string").withColumn("ts", F.timestamp_seconds("seq"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.read_feed(spark, str(tmp_path / "in"), df.schema)
    got = feeds.drain(stateful.slashing_stream(stream, 0.7), "s")
    cols = ["seq", "slashed", "penalty", F.col("total_severity").cast("double")]
    assert rows(got, *cols) == rows(staking.slashing(df, 0.7), *cols)


def test_upsert_log(spark, feed, events, tmp_path):
    order = ["slot", "write_version", "seq"]
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    source = X.account_updates(feed)
    feeds.stream_upsert(source, log, state, "pubkey", order).awaitTermination()
    want = latest.upsert_accounts(None, X.account_updates(events))
    same(feeds.read_upserted(spark, log, want.schema, "pubkey", order), want)
    # compaction while the stream may go on; a batch that is written again replaces itself
    feeds.compact_log(spark, log, want.schema, "pubkey", order)
    assert numbered(spark, log, "batch_id") == [2] and numbered(spark, f"{log}/compact", "upto") == [1]
    same(feeds.read_upserted(spark, log, want.schema, "pubkey", order), want)
    feeds.batch_folder(log)(want.limit(0), 2)
    feeds.batch_folder(log)(X.account_updates(events), 2)
    same(feeds.read_upserted(spark, log, want.schema, "pubkey", order), want)
    # a restart finds nothing new
    feeds.stream_upsert(source, log, state, "pubkey", order).awaitTermination()
    same(feeds.read_upserted(spark, log, want.schema, "pubkey", order), want)


def test_counters(spark, feed, events, tmp_path):
    job = lambda e: X.slot_messages(e).select(
        "kind", (F.col("seq") % 7 == 0).alias("error"), (F.col("seq") % 7 != 0).alias("published"), F.col("seq").alias("seconds")
    )
    query = feeds.live_counters(job(feed), "kind", str(tmp_path / "c"), str(tmp_path / "s"))
    query.awaitTermination()
    same(feeds.read_counters(spark, str(tmp_path / "c"), "kind").drop("per_second"), stats.pipeline_counters(job(events)))
    seen = [p.observedMetrics["feed"]["received"] for p in query.recentProgress if "feed" in p.observedMetrics]
    assert sum(seen) == events.count()


def test_live_tracker(spark, views, tmp_path):
    orders = views.base("orders")
    for i in range(3):
        orders.filter(F.col("o_orderkey") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = feeds.read_feed(spark, str(tmp_path / "in"), orders.schema, 1)
    tx = X.transactions(source, views.base("lineitem"), views.base("part"))
    feeds.live_tracker(tx, "Brand#13", str(tmp_path / "out"), str(tmp_path / "s1"), keep=30).awaitTermination()
    want = topk.tracker_view(views.transactions, "Brand#13", keep=30).drop("shown")
    assert rows(feeds.read_live(spark, str(tmp_path / "out"), want.schema), "signature", "instruction_type") == rows(want, "signature", "instruction_type")

    daily = feeds.live_daily(tx)
    feeds.live_table(daily, str(tmp_path / "daily"), str(tmp_path / "s2")).awaitTermination()
    same(feeds.read_live(spark, str(tmp_path / "daily"), daily.schema), feeds.live_daily(views.transactions))


# --- blocks with rewards and entries ------------------------------------------------------------------


@pytest.mark.parametrize("keep", [None, 1000])
def test_block_rewards(feed, events, keep):
    got = feeds.drain(stateful.assemble_blocks_stream(X.block_messages(feed), keep), "b")
    want = assemble_blocks(X.block_messages(events))
    assert want.filter("size(rewards) > 1").count() > 0 and want.filter("size(rewards) = 0").count() > 0
    same(reward_texts(got), reward_texts(want))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_block_entries(feed, events, size):
    got = feeds.drain(stateful.block_entries_stream(X.block_messages(feed), size), "e")
    want = block_entries(X.block_messages(events), size)
    assert want.filter(F.size("entries") > size).count() == 0 and want.count() > 0
    same(entry_texts(got), entry_texts(want))


def test_block_entries_are_those_of_the_block(events):
    """Full chunks up to a block's message and the open one under it hold as many entries as there were."""
    messages = X.block_messages(events)
    parts = block_entries(messages, 3).select("slot", F.col("seq").alias("at"), F.size("entries").alias("n"))
    blocks = assemble_blocks(messages).select("slot", "seq")
    held = blocks.join(parts, "slot").filter("at = seq or (at < seq and n = 3)").groupBy("slot", "seq").agg(F.sum("n").alias("n"))
    # an open chunk that was given at an earlier publication has fewer than three entries, or was full then
    want = blocks.join(messages.filter("kind = 'entry'").select("slot", F.col("seq").alias("at")), "slot").filter("at < seq").groupBy("slot", "seq").agg(F.count("*").alias("n"))
    assert rows(held) == rows(want)


def test_rewards_are_exact_and_replaced(spark, tmp_path):
    schema = X.block_messages(spark.read.parquet(f"{SF}/events.parquet")).schema
    big = 2**53 + 1
    reward = lambda n: {"pubkey": "p", "lamports": big + n, "post_balance": None, "reward_type": None, "commission": None}

    def message(seq, kind, **more):
        values = {"slot": 9, "seq": seq, "kind": kind, **more}
        return tuple(values.get(c) for c in schema.names)

    parts = [
        [message(1, "entry", num_hashes=big, executed_tx=1), message(2, "status", status="rooted", parent=8)],
        [message(3, "metadata", blockhash="a", rewards=[reward(0), reward(1)]), message(4, "entry", num_hashes=None)],
        [message(5, "metadata", blockhash="b", rewards=[])], [message(6, "metadata", blockhash="c")], [message(7, "metadata", blockhash="d", rewards=[reward(2)])],
    ]
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    source = feeds.read_feed(spark, path, schema, 1)
    table = spark.createDataFrame([m for part in parts for m in part], schema)
    for made in (feeds.drain(stateful.assemble_blocks_stream(source), "r"), assemble_blocks(table)):
        paid = {r["seq"]: [x["lamports"] - big for x in r["rewards"]] for r in made.collect()}
        assert paid == {2: [], 3: [0, 1], 5: [], 6: [], 7: [2]}
    for made in (feeds.drain(stateful.block_entries_stream(source), "e"), block_entries(table)):
        assert {r["seq"]: [x["num_hashes"] for x in r["entries"]] for r in made.collect()} == {2: [big], 3: [big], 5: [big, None], 6: [big, None], 7: [big, None]}


# --- folds in two stages -------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [7, 1_000_000])
def test_advancing_slots_folded(spark, feed, events, tmp_path, width):
    job = lambda e: X.account_updates(e).select("seq", "owner", "slot")
    path = str(tmp_path / "f")
    start = lambda: folds.advancing_slots(job(feed), ["owner"], ["seq"], path, str(tmp_path / "s"), ordered.seq_bucket(width=width))
    start().awaitTermination()
    want = ordered.advancing_slots(job(events), ["owner"], ["seq"], ordered.seq_bucket())
    same(folds.read_rows(spark, path, want.schema), want)
    start().awaitTermination()  # nothing new
    same(folds.read_rows(spark, path, want.schema), want)


def test_slashing_folded(spark, feed, events, tmp_path):
    job = lambda e: X.violations(e).withColumn("violation", F.when(F.col("seq") % 7 > 0, "violation"))
    folds.slashing(job(feed), 5.0, str(tmp_path / "f"), str(tmp_path / "s")).awaitTermination()
    want = staking.slashing(job(events), 5.0)
    got = folds.read_rows(spark, str(tmp_path / "f"), folds.slashing_columns(job(events).schema))
    cols = ["operator", "seq", "slashed", "penalty", F.col("total_severity").cast("double")]
    assert rows(got, *cols) == rows(want, *cols)


def test_folded_batches_replay(spark, feed, events, tmp_path):
    """A batch that failed between its rows and its carries is run again and gives the same."""
    job = lambda e: X.account_updates(e).select("seq", "owner", "slot")
    path, state = str(tmp_path / "f"), str(tmp_path / "s")
    upsert, calls = folds.KeyedTable.upsert, []

    def failing(self, frame, batch=None):
        calls.append(batch)
        if calls == [0, 1]:
            raise RuntimeError("lost")
        return upsert(self, frame, batch)

    folds.KeyedTable.upsert = failing
    try:
        start = lambda: folds.advancing_slots(job(feed), ["owner"], ["seq"], path, state, ordered.seq_bucket(width=50))
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
        start().awaitTermination()
    finally:
        folds.KeyedTable.upsert = upsert
    assert calls[:3] == [0, 1, 1]
    want = ordered.advancing_slots(job(events), ["owner"], ["seq"], ordered.seq_bucket())
    same(folds.read_rows(spark, path, want.schema), want)


def test_folds_bring_no_key_together(spark):
    """A million rows of one key in a batch: windows run over ranges of it, Python over none."""
    hot = spark.range(1_000_000).select(F.lit("k").alias("owner"), F.col("id").alias("seq"), ((F.col("id") * 7919) % 1_000_003).alias("slot"))
    carries = spark.createDataFrame([("k", 999_000)], "owner string, _seen bigint")
    made = folds.fold_batch(hot, carries, ["owner"], ["seq"], ordered.seq_bucket(width=1000), {"_seen": ("max", F.col("slot"))}, before=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "windowspecdefinition(_range#" in plan and "windowspecdefinition(owner#" not in plan
    above = made.filter("_seen is null or slot > _seen").orderBy("seq").collect()
    seen, want = 999_000, []
    for i in range(1_000_000):
        slot = i * 7919 % 1_000_003
        if slot > seen:
            seen = slot
            want.append(i)
    assert [r["seq"] for r in above] == want


# --- batches by count or time, ids that expire, and what queries report --------------------------------


def test_batches_close_by_count(spark, feed, events, tmp_path):
    job = lambda e: X.account_updates(e).select("seq", (F.col("seq") % 3).alias("lane"), F.when(F.col("seq") % 2 == 0, F.col("seq") + 2**53).alias("big"))
    made = stateful.micro_batches(job(feed), "lane", ["seq"], 40, "1 day")
    feeds.start(made, str(tmp_path / "o"), str(tmp_path / "s"), by_clock=True).awaitTermination()
    closed = spark.read.schema(made.schema).parquet(str(tmp_path / "o"))
    open_ = stateful.open_batches(spark, str(tmp_path / "s"), made.schema, "lane")
    want = ordered.batch_ids(job(events), 40, ["lane"], ["seq"], ordered.seq_bucket())
    same(closed.unionByName(open_).drop("closed_by"), want)
    assert {r["count"] for r in closed.groupBy("lane", "batch_id").count().collect()} == {40}
    assert {r["closed_by"] for r in closed.select("closed_by").distinct().collect()} == {"count"} and 0 < open_.count() < 3 * 40


def _arrive(spark, path, schema, *parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def _until(query, done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        if query.exception():
            raise query.exception()
        time.sleep(0.3)
    assert done()


def test_batches_close_by_time(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "lane bigint, seq bigint, note string"
    _arrive(spark, path, schema, [(1, i, "a") for i in range(5)] + [(2, 7, None)])
    made = stateful.micro_batches(feeds.read_feed(spark, path, spark.createDataFrame([], schema).schema, 1), "lane", ["seq"], 4, "200 milliseconds")
    query = feeds.start(made, str(tmp_path / "o"), str(tmp_path / "s"), every="200 milliseconds")
    read = lambda: rows(spark.read.schema(made.schema).parquet(str(tmp_path / "o")), "lane", "seq", "batch_id", "closed_by")
    try:
        _until(query, lambda: len(read()) == 6)  # without new input
        _arrive(spark, path, schema, [(1, 10, "b")])
        _until(query, lambda: len(read()) == 7)
    finally:
        query.stop()
    assert read() == sorted([(1, i, 0, "count") for i in range(4)] + [(1, 4, 1, "time"), (2, 7, 0, "time"), (1, 10, 2, "time")], key=repr)


def test_ids_expire(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "message_id string, seq bigint"
    _arrive(spark, path, schema, [("a", 1), ("a", 2), ("b", 3)])
    source = feeds.read_feed(spark, path, spark.createDataFrame([], schema).schema, 1)
    query = feeds.start(stateful.dedup_expiring(source, "20 seconds"), str(tmp_path / "o"), str(tmp_path / "s"), every="500 milliseconds")
    read = lambda: rows(spark.read.schema(schema).parquet(str(tmp_path / "o")))
    try:
        _until(query, lambda: len(read()) == 2)
        let_through = time.time()
        _arrive(spark, path, schema, [("a", 4), ("c", 5)])
        _until(query, lambda: len(read()) == 3)
        assert time.time() < let_through + 18  # else the test says nothing
        time.sleep(max(0, let_through + 22 - time.time()))
        _arrive(spark, path, schema, [("a", 6)])
        _until(query, lambda: len(read()) == 4)
    finally:
        query.stop()
    assert read() == [("a", 1), ("a", 6), ("b", 3), ("c", 5)]


def test_late_rows_are_kept_aside(spark, tmp_path):
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    parts = [
        [("a", 1, at(0)), ("a", 2, at(5)), ("b", 3, at(50)), (None, 4, at(51)), (None, 5, at(52))],
        [("a", 6, at(30)), ("c", 7, at(100)), ("b", 8, at(110)), ("d", 9, None)],  # a within the hour, b after it
        [("e", 10, at(49)), ("c", 11, at(50)), ("f", 12, at(51)), ("a", 13, at(61)), (None, 14, at(300))],  # the newest was 110: 49 is late, 50 is not
        [("a", 15, at(241)), ("b", 16, at(239)), ("c", 17, at(400))],
    ]
    schema = "message_id string, seq bigint, ts timestamp"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source, path = feeds.read_feed(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out")
    for _ in range(2):
        seen.dedup_by_event_time(source, "1 HOUR", path, str(tmp_path / "s"), buckets=2).awaitTermination()
    got = {side: sorted(r["seq"] for r in seen.read_side(spark, path, side, source.schema).collect()) for side in ("rows", "late")}
    assert got == {"rows": [1, 3, 4, 7, 8, 12, 13, 14, 15, 17], "late": [9, 10, 16]}


def test_rooted_slots_are_swept_by_the_clock(spark, tmp_path):
    schema = X.slot_messages(spark.read.parquet(f"{SF}/events.parquet")).schema
    message = lambda slot, seq, kind, status=None: tuple({"slot": slot, "seq": seq, "kind": kind, "status": status}.get(c) for c in schema.names)
    path = str(tmp_path / "in")
    _arrive(spark, path, schema, [message(1, 1, "entry"), message(1, 2, "status", "rooted"), message(2, 3, "entry"), message(2, 4, "status", "confirmed")])
    made = stateful.assemble_blocks_stream(feeds.read_feed(spark, path, schema, 1), sweep="1 second")
    query = feeds.start(made, str(tmp_path / "o"), str(tmp_path / "s"), every="500 milliseconds")
    state = lambda: [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    read = lambda: rows(spark.read.schema(made.schema).parquet(str(tmp_path / "o")), "slot", "seq", "entry_count")
    try:
        _until(query, lambda: state() and max(state()) >= 2 and state()[-1] < max(state()))  # falls without new input
        _arrive(spark, path, schema, [message(1, 5, "status", "rooted"), message(2, 6, "status", "rooted")])
        _until(query, lambda: len(read()) == 3)
    finally:
        query.stop()
    assert read() == [(1, 2, 1), (1, 5, 0), (2, 6, 1)]  # slot 1 began anew, slot 2 was not rooted
    with pytest.raises(ValueError):
        stateful.assemble_blocks_stream(feeds.read_feed(spark, path, schema, 1), 5, "1 second")


def test_metrics_are_kept(spark, feed, events, tmp_path):
    """What the listener has written equals the batch counts, after a restart and with a second query too; late rows are counted."""
    job = lambda e: X.slot_messages(e).select(
        "kind", (F.col("seq") % 7 == 0).alias("error"), (F.col("seq") % 7 != 0).alias("published"), F.col("seq").alias("seconds")
    )
    path = str(tmp_path / "metrics")
    listener = monitor.listen(spark, path)
    try:
        for _ in range(2):
            query = feeds.live_counters(job(feed), "kind", str(tmp_path / "c"), str(tmp_path / "s"))
            query.awaitTermination()
        # slots go up in seq's order and then all over again, so those of the second half are late
        late = X.slot_messages(feed).withColumn("slot", F.when(F.col("seq") < 667, F.col("slot")).otherwise(F.col("slot") - 33))
        other = feeds.start(stateful.assemble_blocks_stream(late, 5), str(tmp_path / "o"), str(tmp_path / "s2"))
        other.awaitTermination()
        dropped = lambda: monitor.read_metrics(spark, path).filter(F.col("query") == other.id).agg(F.sum("late_rows")).first()[0]
        _until(other, lambda: (tmp_path / "metrics").exists() and dropped() == monitor.late_rows(other))
    finally:
        spark.streams.removeListener(listener)
    assert monitor.late_rows(other) > 0
    want = job(events).agg(F.count("*"), F.count_if("error")).first()
    got = monitor.totals(spark, path, "feed")
    assert rows(got, "query", "counter", "total") == sorted([(query.id, "errors", want[1]), (query.id, "received", want[0])])
    batches_ = monitor.read_metrics(spark, path).filter(F.col("query") == query.id)
    assert batches_.count() == batches_.select("batch").distinct().count() == 3 and batches_.agg(F.sum("rows_in")).first()[0] == events.count()


def test_feed_is_read_in_order_of_its_batches(spark, events, tmp_path):
    path = str(tmp_path / "in")
    feeds.write_feed(events.withColumn("batch", (9 - F.floor(F.col("event_id") / 100)).cast("int")), path, "batch", 10)
    seen = []
    source = feeds.read_feed(spark, path, events.schema, 1, recursiveFileLookup="true")
    feeds.start_batches(source, lambda b, n: seen.append({r[0] // 100 for r in b.select("event_id").collect()}), str(tmp_path / "s")).awaitTermination()
    assert seen == [{k} for k in range(9, -1, -1)]
