"""RPC envelopes: good rows, each required field missing or of the wrong type, and odd shapes."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slotweave.operators import parse as P
from tests.conftest import rows

GOOD_ACCOUNT = {
    "context": {"slot": 7},
    "value": {"lamports": 5, "owner": "o", "executable": False, "rentEpoch": 18446744073709551615, "data": ["AQI=", "base64"]},
}


def text(spark, *bodies, key="pubkey"):
    data = [(f"k{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, f"{key} string, body string")


def changed(path, value, base=GOOD_ACCOUNT):
    """Copy of ``base`` with a field replaced, or removed for ``...``."""
    doc = json.loads(json.dumps(base))
    *parents, last = path.split(".")
    at = doc
    for p in parents:
        at = at[p]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return {"result": doc}


def test_account_response_good(spark):
    got = P.parse_account_response(text(spark, {"result": GOOD_ACCOUNT})).first()
    assert (got.lamports, got.owner, got.executable, got.slot, got.write_version) == (5, "o", False, 7, 0)
    assert got.rent_epoch == Decimal(18446744073709551615)
    assert bytes(got.data) == b"\x01\x02"


@pytest.mark.parametrize("path,value", [
    *[(f"value.{f}", ...) for f in ("lamports", "owner", "executable", "rentEpoch", "data")], ("context.slot", ...), ("context", ...),
    ("value.lamports", "5"), ("value.lamports", 1.5), ("value.lamports", -1), ("value.lamports", 1.0), ("value.lamports", None),
    ("value.lamports", 18446744073709551616), ("value.owner", 7), ("value.executable", 1), ("value.executable", "true"),
    ("value.data", "AQI="), ("value.data", []), ("value.data", ["***", "base64"]), ("value.data", [3]), ("value", None),
])
def test_account_response_drops_incomplete(spark, path, value):
    assert P.parse_account_response(text(spark, changed(path, value))).count() == 0


@pytest.mark.parametrize("body", ["", "{", "[]", "5", "null", '{"result":null}', '{"error":{}}', "{}"])
def test_parsers_drop_other_texts(spark, body):
    assert P.parse_account_response(text(spark, body)).count() == 0
    assert P.parse_transaction_response(text(spark, body, key="signature")).count() == 0
    assert P.parse_transaction_full(text(spark, body, key="signature")).count() == 0
    assert P.parse_account_notification(text(spark, body)).count() == 0


def test_account_lenient(spark):
    got = P.parse_account(text(
        spark, {"result": GOOD_ACCOUNT}, changed("value", {}), changed("value", None), changed("value.data", ["only"]),
        changed("context", ...), changed("value", ...), {}, "{", changed("value.data", [1, 2]),
    ))
    assert rows(got, "pubkey", "rpc_status", "lamports", "owner", "data_base64") == [
        ("k0", "ok", 5, "o", "AQI="), ("k1", "ok", 0, "", None), ("k2", "not_found", None, None, None),
        ("k3", "ok", 5, "o", None), ("k4", "missing_context", None, None, None), ("k5", "missing_value", None, None, None),
        ("k6", "missing_result", None, None, None), ("k7", "invalid", None, None, None), ("k8", "ok", 5, "o", ""),
    ]


TX = {
    "slot": 9, "blockTime": 100,
    "meta": {"fee": 5000, "err": None, "logMessages": ["a", 3]},
    "transaction": {"message": {
        "recentBlockhash": "bh", "accountKeys": ["A", "B", 4],
        "instructions": [
            {"programId": "P", "accounts": [1, 0, 9, -1, "0", 1.5], "data": "0100"},
            {"accounts": [0]}, {"programId": 5}, {"programId": "P"},
        ],
    }},
}


def test_transaction_full(spark):
    got = P.parse_transaction_full(text(spark, {"result": TX}, key="signature")).first()
    assert (got.slot, got.block_time, got.fee, got.err, got.success) == (9, 100, 5000, None, True)
    assert got.accounts == ["A", "B", ""] and got.logs == ["a", ""]
    assert got.program_ids == ["P", "P"]
    assert [(i.program_id, i.accounts, i.data) for i in got.instructions] == [("P", ["B", "A"], "0100"), ("P", [], "")]


def test_transaction_full_error_forms(spark):
    docs = [changed("meta.err", e, TX) for e in (None, ..., {}, {"code": 1}, "x")]
    got = P.parse_transaction_full(text(spark, *docs, key="signature"))
    assert rows(got, "signature", "success", "err") == [
        ("k0", True, None), ("k1", True, None), ("k2", False, "{}"), ("k3", False, '{"code":1}'), ("k4", False, '"x"'),
    ]
    summary = P.parse_transaction_response(text(spark, *docs, key="signature"))
    assert rows(summary, "signature", "err", "status") == [
        ("k0", False, 1), ("k1", False, 1), ("k2", True, 0), ("k3", True, 0), ("k4", True, 0),
    ]


def test_transaction_full_without_instructions(spark):
    docs = [changed("transaction.message.instructions", v, TX) for v in (..., None, [])]
    got = P.parse_transaction_full(text(spark, *docs, key="signature"))
    assert [r.program_ids for r in got.orderBy("signature").collect()] == [["A", "B", ""], ["A", "B", ""], []]
    assert got.filter(F.array_size("instructions") > 0).count() == 0


@pytest.mark.parametrize("path", ["slot", "meta", "meta.fee", "transaction", "transaction.message"])
def test_transaction_full_required(spark, path):
    assert P.parse_transaction_full(text(spark, changed(path, ..., TX), key="signature")).count() == 0


def test_transaction_full_error_key_counts_even_when_null(spark):
    assert P.parse_transaction_full(text(spark, {"error": None, "result": TX}, key="signature")).count() == 0


BLOCK = {
    "slot": 5, "parentSlot": 3, "blockhash": "b", "previousBlockhash": "p", "blockTime": 10, "blockHeight": 4,
    "transactions": [{}, {}],
    "rewards": [
        {"pubkey": "v", "lamports": -1, "postBalance": 2, "rewardType": "voting"},
        {"pubkey": "f", "lamports": 1, "postBalance": 2, "rewardType": "fee"},
        {"pubkey": "x", "lamports": 1, "rewardType": "fee"},
    ],
}


def test_block_full(spark):
    got = P.parse_block_full(text(spark, {"result": BLOCK}).select("body"), now=77).first()
    assert (got.slot, got.parent_slot, got.transaction_count, got.leader, got.block_time) == (5, 3, 2, "f", 10)
    assert [r.pubkey for r in got.rewards] == ["v", "f"]


def test_block_full_defaults(spark):
    got = P.parse_block_full(text(spark, {"result": {}}, {"result": None}).select("body"), now=77).collect()
    assert len(got) == 2
    for r in got:
        assert (r.slot, r.parent_slot, r.blockhash, r.previous_blockhash, r.block_time, r.block_height) == (0, 0, "unknown", "unknown", 77, 0)
        assert r.leader == "1" * 32 and r.rewards == [] and r.transaction_count == 0


@pytest.mark.parametrize("field", ["blockhash", "parentSlot", "previousBlockhash", "transactions"])
def test_block_response_required(spark, field):
    df = spark.createDataFrame([(5, json.dumps(changed(field, ..., BLOCK)))], "slot bigint, body string")
    assert P.parse_block_response(df).count() == 0


def test_notifications(spark):
    docs = [
        {"method": "accountNotification", "params": ["A", {"result": GOOD_ACCOUNT}]},
        {"method": "accountNotification", "params": ["A"]},
        {"method": "signatureNotification", "params": ["S", {"result": {"context": {"slot": 3}, "value": {"err": None}}}]},
        {"method": "signatureNotification", "params": ["S", {"result": {"context": {"slot": 3}}}]},
        {"method": "slotNotification", "params": [0]},
        {"method": "slotNotification", "params": []},
        {"method": "other"}, {"method": 5}, "{",
    ]
    df = text(spark, *docs)
    assert [r.route for r in P.route_notification(df).orderBy("pubkey").collect()] == [
        "account", "account", "transaction", "transaction", "slot", "slot", "unhandled", "unhandled", "invalid",
    ]
    assert rows(P.parse_account_notification(df), "pubkey", "lamports", "slot") == [("A", 5, 7)]
    assert rows(P.parse_signature_notification(df), "signature", "slot", "err", "status") == [("S", 3, False, 1)]
    assert rows(P.parse_slot_notification(df), "slot", "parent_slot") == [(0, 0)]


def test_text_is_parsed_once_per_row(spark, tmp_path):
    text(spark, {"result": GOOD_ACCOUNT}).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for parsed in (P.parse_account_response(df), P.parse_account(df).filter("rpc_status = 'ok'"), P.parse_account_notification(df)):
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson") == 1
