"""Plans that must hold at scale: what is pushed down, what is shuffled, and what is never planned."""

import re

import pytest

import __spark_entry__ as entry_points
from slotweave.operators import filters, latest, lookups, ordered, staking, stats, topk
from tests.conftest import SF

BATCH = sorted(n for n in entry_points.queries() if n not in entry_points.LLM_QUERIES and not n.endswith(("_stream", "_watermark")) and not n.startswith(("t2", "t5", "t8", "t9_live", "t10")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below_exchanges(df):
    """For each scan of a plan, the nodes from it up to the first exchange."""
    lines = plan(df).splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i in (i for i, line in enumerate(lines) if "FileScan" in line):
        path, level = "", depth[i]
        for line, at in zip(lines[i::-1], depth[i::-1]):
            if at < level:
                path, level = path + line, at
                if "Exchange" in line:
                    break
        yield path


def count(pattern, df):
    return len(re.findall(pattern, plan(df)))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins(spark, name):
    assert count("NestedLoop|Cartesian", entry_points.queries()[name](spark, SF)) == 0


def test_daily_stats_reads_orders_only(views):
    df = stats.daily_stats(views.transactions)
    assert count("FileScan", df) == 1 and count("Join", df) == 0
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan(df)


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    schema = "pubkey string, slot bigint, write_version bigint, seq bigint, lamports bigint"
    spark.createDataFrame([("a", 1, 1, 1, 1)], schema).write.parquet(str(tmp_path / "a"))
    current = latest.upsert_accounts(None, spark.read.parquet(str(tmp_path / "a")))
    assert "PushedFilters: [IsNotNull(pubkey), EqualTo(pubkey,a)]" in plan(filters.get_by_key(current, "pubkey", "a"))


def test_newest_rows_are_a_top_k_without_a_key_shuffle(views):
    df = lookups.transactions_by_account(views.transactions.drop("instructions"), "supp7", 10)
    assert count("TakeOrderedAndProject", df) == 1
    assert count("TakeOrderedAndProject", topk.recent_transactions(views.transactions, 5)) == 1


def test_top_per_key_cuts_before_the_shuffle(views):
    assert count("WindowGroupLimit", staking.top_peers(views.operators)) == 2
    assert count("WindowGroupLimit", ordered.recent_per_key(views.votes, ["validator"], n=1000)) == 4


def test_running_fold_shuffles_rows_once(views, no_broadcast):
    df = staking.slashing(views.violations, 5.0)
    assert count("Exchange hashpartitioning", df) == 8  # rows; for sums, wide sums and the starts from both: range totals
    assert sorted("partial_sum" in x for x in below_exchanges(df)) == [False, True, True]  # of the scans, one feeds rows to a shuffle


def test_hot_key_sums_leave_the_join_partitioning(views, no_broadcast):
    text = plan(staking.epoch_rewards(views.scores, views.multipliers))
    join, final = text.index("SortMergeJoin"), text.index("HashAggregate")
    assert "Exchange hashpartitioning(_groupingexpression" in text[final:join]
    assert "partial_sum" in text[final:join]


def test_long_key_lists_are_broadcast_only_when_small(views, monkeypatch, no_broadcast):
    keys = [f"acct{i}" for i in range(2000)]
    assert count("BroadcastHashJoin", filters.select_accounts(views.account_updates, keys)) == 1
    monkeypatch.setattr(filters, "BROADCAST_BYTES", 10)
    assert count("BroadcastHashJoin", filters.select_accounts(views.account_updates, keys)) == 0


def test_global_folds_keep_only_range_totals_in_one_task(views):
    text = plan(ordered.advancing_slots(views.account_updates, [], ["seq"], ordered.seq_bucket("seq", 100)))
    single = text.index("Exchange SinglePartition")
    assert text[single:].count("partial_max") == 2  # sums of ranges, then of FAN ranges each
    assert text.count("SinglePartition") == 1
