"""Ordered jobs against plain sequential folds, with a hot key and tiny ranges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slotweave.functions.scalars import DEFAULT_PENALTY
from slotweave.operators import ordered as O
from slotweave.operators.staking import slashing
from tests.conftest import rows


def skewed(seed, n, keys=5):
    """(key, seq, slot, amount): one key holds about half of the rows; arrival order is shuffled."""
    rnd = random.Random(seed)
    out = [
        ("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(keys)}", i, rnd.randrange(n), rnd.randrange(1, 100))
        for i in range(n)
    ]
    rnd.shuffle(out)
    return out


def frame(spark, data, parts=7):
    return spark.createDataFrame(data, "key string, seq bigint, slot bigint, amount bigint").repartition(parts)


def by_key(data):
    groups = defaultdict(list)
    for r in sorted(data, key=lambda r: r[1]):
        groups[r[0]].append(r)
    return groups


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("before", [False, True])
def test_running(spark, width, before):
    data = skewed(1, 300)
    got = O.running(
        frame(spark, data), ["key"], ["seq"], O.seq_bucket("seq", width),
        {"s": ("sum", F.col("amount")), "c": ("count", F.lit(1)), "mx": ("max", F.col("slot")), "mn": ("min", F.struct("slot", "seq"))},
        before,
    )
    want = []
    for key, group in by_key(data).items():
        for i, r in enumerate(group):
            seen = group[: i if before else i + 1]
            want.append((
                key, r[1], sum(x[3] for x in seen) if seen else None, len(seen), max((x[2] for x in seen), default=None),
                min((x[2] for x in seen), default=None),
            ))
    assert rows(got.select("key", "seq", "s", "c", "mx", "mn.slot")) == sorted(want, key=repr)


def test_running_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 5), ("a", 2)], "key string, seq bigint")
    got = O.running(df, ["key"], ["seq"], O.seq_bucket("seq", 2), {"c": ("count", F.lit(1))})
    assert rows(got, "seq", "c") == [(1, 1), (2, 1), (5, 2)]


@pytest.mark.parametrize("keys", [["key"], []])
def test_advancing_slots(spark, keys):
    data = skewed(2, 400)
    got = O.advancing_slots(frame(spark, data), keys, ["seq"], O.seq_bucket("seq", 13))
    top, want = {}, []
    for r in sorted(data, key=lambda r: r[1]):
        k = r[0] if keys else None
        if k not in top or r[2] > top[k]:
            top[k] = r[2]
            want.append((r[1],))
    assert rows(got, "seq") == sorted(want, key=repr)


@pytest.mark.parametrize("size", [0, 1, 7])
def test_batch_ids(spark, size):
    data = skewed(3, 200)
    got = O.batch_ids(frame(spark, data), size, ["key"], ["seq"], O.seq_bucket("seq", 17))
    want = [(r[1], i // size if size else 0) for g in by_key(data).values() for i, r in enumerate(g)]
    assert rows(got, "seq", "batch_id") == sorted(want, key=repr)


@pytest.mark.parametrize("salt", [1, 8])
@pytest.mark.parametrize("n", [1, 25, 5000])
def test_recent_per_key(spark, salt, n):
    data = skewed(4, 300)
    got = O.recent_per_key(frame(spark, data), ["key"], "seq", n, salt)
    want = [(k, r[1], i + 1) for k, g in by_key(data).items() for i, r in enumerate(reversed(g)) if i < n]
    assert rows(got, "key", "seq", "rn") == sorted(want, key=repr)


@pytest.mark.parametrize("seed,interval,width", [(5, 10, 1), (6, 10, 45), (7, 60, 120), (8, 1, 30), (9, 500, 1_000_000)])
def test_distribution_gate(spark, seed, interval, width):
    rnd = random.Random(seed)
    data = [("hot" if rnd.random() < 0.6 else "cold", rnd.randrange(0, 3000), i) for i in range(900)]
    df = spark.createDataFrame(data, "key string, t bigint, seq bigint").repartition(5)
    for keys in (["key"], []):
        last, want = {}, []
        for key, t, seq in sorted(data, key=lambda r: (r[1], r[2])):
            k = key if keys else None
            if k not in last or t - last[k] >= interval:
                last[k] = t
                want.append((seq,))
        assert rows(O.distribution_gate(df, keys, "t", "seq", interval, width), "seq") == sorted(want, key=repr)


def test_distribution_gate_without_interval_keeps_all(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2)], "key string, t bigint, seq bigint")
    assert O.distribution_gate(df, ["key"], "t", "seq", 0).count() == 2


def test_distribution_gate_with_nulls(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 5, 2), (None, 12, 3), ("a", 3, 4), ("a", None, 5)], "key string, t bigint, seq bigint")
    assert rows(O.distribution_gate(df, ["key"], "t", "seq", 10), "seq") == [(1,), (3,), (4,)]


def test_running_over_many_wide_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "FAN", 3)
    data = skewed(21, 300)
    got = O.running(frame(spark, data), ["key"], ["seq"], O.seq_bucket("seq", 4), {"s": ("sum", F.col("amount")), "c": ("count", F.lit(1)), "m": ("max", F.col("slot"))})
    want = [(r[1], sum(x[3] for x in g[: i + 1]), i + 1, max(x[2] for x in g[: i + 1])) for g in by_key(data).values() for i, r in enumerate(g)]
    assert rows(got, "seq", "s", "c", "m") == sorted(want, key=repr)


def test_delegation_ledger(spark):
    rnd = random.Random(10)
    data = [("o", "hot" if rnd.random() < 0.5 else f"s{rnd.randrange(4)}", i, rnd.choice(["add", "add", "remove"]), rnd.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "operator string, staker string, seq bigint, op string, amount bigint").repartition(5)
    balances, removals = O.delegation_ledger(df, O.seq_bucket("seq", 11))
    held, out = {}, []
    for _, staker, seq, op, amount in data:
        if op == "add":
            held[staker] = held.get(staker, 0) + amount
        else:
            out.append((seq, staker, held.pop(staker, None)))
    assert rows(balances, "staker", "amount") == sorted(held.items(), key=repr)
    assert rows(removals, "seq", "staker", "amount") == sorted(out, key=repr)
    assert {r.seq for r in removals.filter("error is not null").collect()} == {s for s, _, a in out if a is None}


def stake_fold(data, minimum, cap):
    totals, out = defaultdict(int), {}
    for op, seq, amount in sorted(data, key=lambda r: r[1]):
        if amount < minimum:
            out[seq] = "below minimum"
        elif totals[op] + amount > cap:
            out[seq] = "over cap"
        else:
            totals[op] += amount
            out[seq] = "accepted"
    return out


@pytest.mark.parametrize("seed,cap,chunk", [(11, 900, 8), (12, 5000, 64), (13, 300, 3), (14, 10**9, 4), (15, 0, 4), (16, 2000, 1000)])
def test_stake_with_cap(spark, seed, cap, chunk):
    rnd = random.Random(seed)
    data = [("hot" if rnd.random() < 0.5 else f"o{rnd.randrange(3)}", i, rnd.choice([rnd.randrange(1, 20), rnd.randrange(1, 400)])) for i in range(150)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "operator string, seq bigint, amount bigint").repartition(5)
    got = {r.seq: r.decision for r in O.stake_with_cap(df, 5, cap, chunk=chunk).collect()}
    assert got == stake_fold(data, 5, cap)


def test_stake_with_cap_with_nulls_and_zeros(spark):
    data = [(None, 1, 60), (None, 2, 60), (None, 3, 40), ("a", 4, None), ("b", 5, 90), ("b", 6, None), ("b", 7, 20), ("b", 8, 0), ("b", 9, 10), ("b", 10, 0)]
    df = spark.createDataFrame(data, "operator string, seq bigint, amount bigint")
    got = {r.seq: r.decision for r in O.stake_with_cap(df, 0, 100, chunk=1).collect()}
    over, yes = "over cap", "accepted"
    assert got == {1: yes, 2: over, 3: yes, 4: "invalid", 5: yes, 6: "invalid", 7: over, 8: yes, 9: yes, 10: yes}


def test_stake_sums_beyond_a_long(spark):
    big = 2**61
    data = [("a", i, big) for i in range(9)] + [("b", 10, 5), ("b", 11, -3), ("c", 12, 2**62 - 1), ("c", 13, 1)]
    df = spark.createDataFrame(data, "operator string, seq bigint, amount bigint")
    got = {r.seq: r.decision for r in O.stake_with_cap(df, -10, 2**62 - 1, chunk=2).collect()}
    assert got == {**{i: "accepted" if i < 1 else "over cap" for i in range(9)}, 10: "accepted", 11: "accepted", 12: "accepted", 13: "over cap"}


def test_stake_rounds_do_not_grow_with_zeros(spark, monkeypatch):
    rounds = []
    hand_over = O.hand_over
    monkeypatch.setattr(O, "hand_over", lambda df: rounds.append(1) or hand_over(df))
    df = spark.createDataFrame([("a", i, 0 if i % 2 else 60) for i in range(200)], "operator string, seq bigint, amount bigint")
    assert O.stake_with_cap(df, 0, 100, chunk=2).filter("decision = 'accepted'").count() == 101
    assert len(rounds) == 1


def test_stake_with_cap_on_derived_table(views):
    from slotweave.plans.relational import STAKE_CAP, STAKE_MIN

    data = views.stake_events.collect()
    want = stake_fold([(r.operator, (r.seq, r.tie, r.amount, r.operator), r.amount) for r in data], STAKE_MIN, STAKE_CAP)
    got = O.stake_with_cap(views.stake_events, STAKE_MIN, STAKE_CAP, order=["seq", "tie", "amount"]).collect()
    assert len(got) == len(want)
    assert {(r.seq, r.tie, r.amount, r.operator): r.decision for r in got} == want
    assert {r.decision for r in got} == {"accepted", "below minimum", "over cap"}


def test_slashing_with_unknown_violations(spark):
    data = [("a", 1, "unknown"), ("a", 2, "DoubleProposal"), ("a", 3, None)]
    df = spark.createDataFrame(data, "operator string, seq bigint, violation string").withColumn("ts", F.timestamp_seconds("seq"))
    got = slashing(df, 0.7)
    assert [(s, float(t), x) for s, t, x in rows(got, "seq", "total_severity", "slashed")] == [(1, 0.0, False), (2, 0.7, True), (3, 0.7, True)]
    assert rows(got.filter("seq = 3"), "penalty") == [(DEFAULT_PENALTY,)]


def test_slashing(spark):
    data = [("a", 1, "MaliciousValidation"), ("a", 2, "LowUptime"), ("a", 3, "DoubleVote"), ("b", 1, "DoubleProposal")]
    df = spark.createDataFrame(data, "operator string, seq bigint, violation string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 3600))
    got = slashing(df, 1.5)
    assert [(o, s, float(t), x, p) for o, s, t, x, p in rows(got, "operator", "seq", "total_severity", "slashed", "penalty")] == [
        ("a", 1, 1.0, False, 0), ("a", 2, 1.5, True, 1000), ("a", 3, 2.3, True, 7500), ("b", 1, 0.7, False, 0),
    ]
