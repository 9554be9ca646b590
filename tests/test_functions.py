import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slotweave.functions import scalars as X
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("lamports,short,full", [
    (1_500_000_000, "1.5000 SOL", "1.500000000 SOL"), (0, "0.0000 SOL", "0.000000000 SOL"),
    (1, "0.000000001 SOL", "0.000000001 SOL"), (1_234_567_890_123_456, "1,234,567.890123456 SOL", "1,234,567.890123456 SOL"),
    (18446744073709551615, "18,446,744,073.709551615 SOL", "18,446,744,073.709551615 SOL"), (None, "N/A", "N/A"),
])
def test_format_sol(spark, lamports, short, full):
    c = F.lit(None if lamports is None else Decimal(lamports)).cast("decimal(20,0)")
    assert one(spark, X.format_sol(c)) == short
    assert one(spark, X.format_sol(c, 9, 9)) == full


@pytest.mark.parametrize("key,short", [("ABCDEFGHIJ", "ABCD...GHIJ"), ("AB", "AB...AB"), ("", "Unknown"), (None, "Unknown")])
def test_truncate_key(spark, key, short):
    assert one(spark, X.truncate_key(F.lit(key).cast("string"))) == short


@pytest.mark.parametrize("key,valid", [
    ("1" * 32, True), ("1" * 31, False), ("1" * 33, False), ("So11111111111111111111111111111111111111112", True),
    ("TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", True), ("0" * 32, False), ("z" * 44, False), ("", False), (None, False),
])
def test_is_valid_pubkey(spark, key, valid):
    assert one(spark, X.is_valid_pubkey(F.lit(key).cast("string"))) is valid


def test_base58(spark):
    assert one(spark, X.base58_encode(F.unhex(F.lit("0000287fb4cd")))) == "11233QC4"


def test_time(spark):
    assert one(spark, X.format_timestamp(F.lit(0))) == "1970-01-01 00:00:00 UTC"
    assert one(spark, X.unix_to_datetime(F.lit(86400))) == dt.datetime(1970, 1, 2)
    now = 1_700_000_000
    assert one(spark, X.duration_since(F.lit(now - 3600), now)) == 3600
    assert one(spark, X.duration_since(F.lit(now + 5), now)) == 0
    assert one(spark, X.is_recent(F.lit(now), 10, now)) is True
    assert one(spark, X.is_recent(F.lit(now - 3600), 60, now)) is False


@pytest.mark.parametrize("score,multiplier,reward", [
    (12345.0, None, 1234), (12345.0, 2.0, 2469), (0.99, 1.0, 0), (-50.0, 1.0, 0), (float("nan"), 1.0, 0),
    (float("inf"), 1.0, 18446744073709551615), (1e25, 1.0, 18446744073709551615), (1e20, 1.0, 10**19),
])
def test_reward_amount(spark, score, multiplier, reward):
    m = F.lit(multiplier).cast("double")
    assert one(spark, X.reward_amount(F.lit(score), m)) == reward


@pytest.mark.parametrize("amount,commission", [(1000, 100), (500, 50), (9, 0), (19, 1), (0, 0), (18446744073709551615, 1844674407370955264)])
def test_split_commission(spark, amount, commission):
    got = one(spark, X.split_commission(F.lit(Decimal(amount))))
    assert got.commission == commission and got.commission + got.net == amount


@pytest.mark.parametrize("stake,priority", [(0, 0), (1, 0), (9, 0), (10, 1), (1_000_000_000, 9), (999_999_999, 8)])
def test_message_priority(spark, stake, priority):
    assert one(spark, X.message_priority(F.lit(stake))) == priority


def test_instruction_type(spark):
    schema = "id int, ins array<struct<program_id:string,accounts:array<string>,data:string>>"
    data = [
        (1, []), (2, None), (3, [("Q", [], "01000000")]), (4, [("Q", [], "02000000"), ("P", [], "01000000ff"), ("P", [], "03000000")]),
        (5, [("P", [], "99")]), (6, [("P", [], "")]),
    ]
    got = spark.createDataFrame(data, schema).select("id", X.instruction_type("ins", "P").alias("t"))
    assert rows(got) == [
        (1, "Unknown"), (2, "Unknown"), (3, "Other"), (4, "Swap"), (5, "Unknown Instruction"), (6, "Unknown Instruction"),
    ]


def test_small_tables(spark):
    roles = spark.range(4).select("id", X.account_role_flags("id").alias("r")).select("id", "r.*")
    assert rows(roles) == [(0, False, False), (1, False, True), (2, True, False), (3, True, True)]
    names = spark.range(4).select(X.commitment_name("id").alias("n"))
    assert [r.n for r in names.collect()] == ["unconfirmed", "confirmed", "finalized", None]
    assert one(spark, X.base_penalty(F.lit("Other"))) == 1000
    assert one(spark, X.severity(F.lit("DoubleVote"))) == Decimal("0.8")
    assert one(spark, X.token_ui_amount(F.lit(Decimal(1500000)), F.lit(6))) == 1.5
    assert [one(spark, X.probe_status(F.lit(p))) for p in ("ok", "http_error", "timeout")] == ["healthy", "degraded", "unhealthy"]
    assert [one(spark, X.saturating_prev_slot(F.lit(s))) for s in (0, 1, 9)] == [0, 0, 8]


@pytest.mark.parametrize("kind,sol,slot,tokens,text", [
    ("account", 2_000_000_000, None, None, "2.0000 SOL"), ("account", 0, None, None, "No data"), ("transaction", None, 5, None, "Slot: 5"),
    ("transaction", None, 0, None, "No data"), ("token", None, None, 0, "0 tokens"), ("token", None, None, None, "No data"), ("x", 1, 1, 1, "No data"),
])
def test_key_data(spark, kind, sol, slot, tokens, text):
    long = lambda x: F.lit(x).cast("bigint")
    assert one(spark, X.key_data(F.lit(kind), long(sol), long(slot), long(tokens))) == text
