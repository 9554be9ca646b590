"""JSON-RPC text to typed rows.

The text is parsed once into a VARIANT; every field is then a typed path read. ``strict`` parsers
drop a row with any required field missing or of the wrong type, lenient ones fill defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions import json as J
from slotweave.functions.scalars import SYSTEM_ID, saturating_prev_slot
from slotweave.schemas import INSTRUCTION

NO_TEXTS = "array<string>"
REWARDS = "array<struct<pubkey: string, lamports: bigint, post_balance: decimal(20,0), reward_type: string>>"


def _texts(values: Column) -> Column:
    """Array of VARIANT to texts; other types become empty texts."""
    return F.transform(values, lambda x: F.coalesce(J.text(x), F.lit("")))


def _strict_account(v: Column, root: str) -> dict[str, Column]:
    value = f"{root}.value"
    return {
        "lamports": J.u64(v, f"{value}.lamports"),
        "owner": J.text(v, f"{value}.owner"),
        "executable": J.boolean(v, f"{value}.executable"),
        "rent_epoch": J.u64(v, f"{value}.rentEpoch"),
        "data": F.try_to_binary(J.text(v, f"{value}.data[0]"), F.lit("base64")),
        "slot": J.u64_as_long(v, f"{root}.context.slot"),
    }


def _typed(df: DataFrame, keep: list[str], cols: dict[str, Column], required: list[str] = []) -> DataFrame:
    """Evaluate ``cols`` over the parsed value ``v`` once per row, then drop incomplete rows.

    The fields pass through a generator, which a filter cannot be pushed below. In a plain
    projection Catalyst would push the not-null tests to the scan and parse the text again for
    every one of them.
    """
    fields = F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    out = df.select(*keep, J.parse("body").alias("v")).select(*keep, fields)
    return out.dropna(subset=required) if required else out


# --- responses ----------------------------------------------------------------------------------


def route_rpc(df: DataFrame) -> DataFrame:
    """Replaces ``body`` by ``rpc_status``: invalid / error / missing_result / not_found / ok."""
    v = F.col("v")
    status = (
        F.when(v.isNull(), "invalid")
        .when(J.present(v, "$.error"), "error")
        .when(~J.present(v, "$.result"), "missing_result")
        .when(J.is_null(v, "$.result"), "not_found")
        .otherwise("ok")
    )
    return _typed(df, [c for c in df.columns if c != "body"], {"rpc_status": status})


def parse_account_response(df: DataFrame) -> DataFrame:
    """Strict. Input ``pubkey, body``; one row per complete account."""
    cols = _strict_account(F.col("v"), "$.result")
    return _typed(df, ["pubkey"], cols, list(cols)).select(
        "pubkey", *cols, F.lit(0).cast("bigint").alias("write_version"), F.lit(False).alias("is_startup")
    )


def parse_account(df: DataFrame) -> DataFrame:
    """Lenient. Input ``pubkey, body``; missing fields take defaults, other columns pass through.

    ``rpc_status`` says why a row has no account: the null value of an unknown account reads as
    ``not_found``. Account columns are NULL on those rows.
    """
    v = F.col("v")
    data = J.items(v, "$.result.value.data")
    status = (
        F.when(v.isNull(), "invalid")
        .when(~J.present(v, "$.result"), "missing_result")
        .when(~J.present(v, "$.result.context"), "missing_context")
        .when(~J.present(v, "$.result.value"), "missing_value")
        .when(J.is_null(v, "$.result.value"), "not_found")
        .otherwise("ok")
    )
    fields = {
        "lamports": F.coalesce(J.u64(v, "$.result.value.lamports"), F.lit(0).cast("decimal(20,0)")),
        "owner": F.coalesce(J.text(v, "$.result.value.owner"), F.lit("")),
        "executable": F.coalesce(J.boolean(v, "$.result.value.executable"), F.lit(False)),
        "rent_epoch": F.coalesce(J.u64(v, "$.result.value.rentEpoch"), F.lit(0).cast("decimal(20,0)")),
        "data_base64": F.when(F.array_size(data) >= 2, F.coalesce(J.text(F.get(data, 0)), F.lit(""))),
        "slot": F.coalesce(J.u64_as_long(v, "$.result.context.slot"), F.lit(0).cast("bigint")),
    }
    keep = [c for c in df.columns if c != "body"]
    ok = F.col("rpc_status") == "ok"
    routed = _typed(df, keep, {"rpc_status": status, **fields})
    return routed.withColumns({n: F.when(ok, F.col(n)) for n in fields})


def parse_transaction_response(df: DataFrame) -> DataFrame:
    """Strict summary. Input ``signature, body``. A JSON null under ``err`` means success."""
    v = F.col("v")
    logs = F.transform(J.items(v, "$.result.meta.logMessages"), lambda x: J.text(x))
    cols = {
        "slot": J.u64_as_long(v, "$.result.slot"),
        "err": F.coalesce(~J.is_null(v, "$.result.meta.err"), F.lit(False)),
        "fee": J.u64(v, "$.result.meta.fee"),
        "block_time": J.i64(v, "$.result.blockTime"),
        "log_messages": F.coalesce(F.filter(logs, lambda x: x.isNotNull()), F.array().cast(NO_TEXTS)),
    }
    return _typed(df, ["signature"], cols, ["slot", "fee"]).select(
        "signature", *cols, F.when(F.col("err"), 0).otherwise(1).cast("bigint").alias("status")
    )


def parse_transaction_full(df: DataFrame) -> DataFrame:
    """Input ``signature, body``; one row per usable response, with instructions resolved.

    Account indexes of an instruction become keys; indexes out of range are dropped, and so are
    instructions without a program. Without an instruction list, all keys count as programs.
    """
    v = F.col("v")
    msg = "$.result.transaction.message"
    err = J.node(v, "$.result.meta.err")
    cols = {
        "usable": F.when(~J.present(v, "$.error") & J.present(v, msg), True),
        "slot": J.u64_as_long(v, "$.result.slot"),
        "fee": J.u64(v, "$.result.meta.fee"),
        "block_time": J.i64(v, "$.result.blockTime"),
        "err": F.when(~J.is_null(v, "$.result.meta.err"), F.to_json(err)),
        "recent_blockhash": F.coalesce(J.text(v, f"{msg}.recentBlockhash"), F.lit("")),
        "accounts": F.coalesce(_texts(J.items(v, f"{msg}.accountKeys")), F.array().cast(NO_TEXTS)),
        "logs": _texts(J.items(v, "$.result.meta.logMessages")),
        "raw_instructions": J.records(v, f"{msg}.instructions", ["programId", "accounts", "data"]),
    }

    def instruction(i: Column) -> Column:
        # JSON whole numbers index the key list; anything else resolves to nothing.
        keys = F.transform(
            F.coalesce(J.items(i["accounts"], "$"), F.array().cast("array<variant>")),
            lambda a: F.get(F.col("accounts"), J.i64(a).try_cast("int")),
        )
        return F.struct(
            J.text(i["programId"]).alias("program_id"),
            F.filter(keys, lambda k: k.isNotNull()).alias("accounts"),
            F.coalesce(J.text(i["data"]), F.lit("")).alias("data"),
        )

    raw = F.col("raw_instructions")
    return (
        _typed(df, ["signature"], cols, ["usable", "slot", "fee"])
        .withColumn(
            "instructions",
            F.filter(
                F.transform("raw_instructions", instruction),
                lambda i: i["program_id"].isNotNull(),
            ),
        )
        .withColumn("instructions", F.coalesce("instructions", F.array().cast(f"array<{INSTRUCTION}>")))
        .withColumn(
            "program_ids",
            F.when(raw.isNull(), F.col("accounts")).otherwise(F.transform("instructions", lambda i: i["program_id"])),
        )
        .select(
            "signature", "slot", "block_time", "err", "fee", "recent_blockhash", "program_ids", "accounts",
            "logs", "instructions", F.col("err").isNull().alias("success"),
        )
    )


def parse_block_response(df: DataFrame) -> DataFrame:
    """Strict. Input ``slot, body``."""
    v = F.col("v")
    cols = {
        "blockhash": J.text(v, "$.result.blockhash"),
        "parent_slot": J.u64_as_long(v, "$.result.parentSlot"),
        "parent_blockhash": J.text(v, "$.result.previousBlockhash"),
        "block_time": J.i64(v, "$.result.blockTime"),
        "block_height": J.u64_as_long(v, "$.result.blockHeight"),
        "transaction_count": J.length(v, "$.result.transactions").cast("bigint"),
    }
    required = ["blockhash", "parent_slot", "parent_blockhash", "transaction_count"]
    return _typed(df, ["slot"], cols, required)


def parse_block_full(df: DataFrame, now: int) -> DataFrame:
    """Lenient. Input ``body``; ``now`` stands in for a missing block time."""
    v = F.col("v")
    raw = J.records(v, "$.result.rewards", ["pubkey", "lamports", "postBalance", "rewardType"])
    rewards = F.transform(
        raw,
        lambda r: F.struct(
            J.text(r["pubkey"]).alias("pubkey"),
            J.i64(r["lamports"]).alias("lamports"),
            J.u64(r["postBalance"]).alias("post_balance"),
            J.text(r["rewardType"]).alias("reward_type"),
        ),
    )
    whole = lambda r: (
        r["pubkey"].isNotNull() & r["lamports"].isNotNull() & r["post_balance"].isNotNull() & r["reward_type"].isNotNull()
    )
    first_fee = F.get(F.filter("all_rewards", lambda r: r["reward_type"] == "fee"), 0)["pubkey"]
    cols = {
        "usable": F.when(v.isNotNull() & ~J.present(v, "$.error") & J.present(v, "$.result"), True),
        "slot": F.coalesce(J.u64_as_long(v, "$.result.slot"), F.lit(0).cast("bigint")),
        "parent": J.u64_as_long(v, "$.result.parentSlot"),
        "blockhash": F.coalesce(J.text(v, "$.result.blockhash"), F.lit("unknown")),
        "previous_blockhash": F.coalesce(J.text(v, "$.result.previousBlockhash"), F.lit("unknown")),
        "block_time": F.coalesce(J.i64(v, "$.result.blockTime"), F.lit(now).cast("bigint")),
        "block_height": F.coalesce(J.u64_as_long(v, "$.result.blockHeight"), F.lit(0).cast("bigint")),
        "transaction_count": F.coalesce(J.length(v, "$.result.transactions"), F.lit(0)).cast("bigint"),
        "all_rewards": rewards,
    }
    return _typed(df, [], cols, ["usable"]).select(
        "slot",
        F.coalesce("parent", saturating_prev_slot("slot")).alias("parent_slot"),
        "blockhash",
        "previous_blockhash",
        "block_time",
        "block_height",
        "transaction_count",
        F.coalesce(first_fee, F.lit(SYSTEM_ID)).alias("leader"),
        F.coalesce(F.filter("all_rewards", whole), F.array().cast(REWARDS)).alias("rewards"),
    )


# --- notifications --------------------------------------------------------------------------------


def _route(v: Column) -> Column:
    method = J.text(v, "$.method")
    return (
        F.when(v.isNull(), "invalid")
        .when(method == "accountNotification", "account")
        .when(method == "signatureNotification", "transaction")
        .when(method == "slotNotification", "slot")
        .otherwise("unhandled")
    )


def route_notification(df: DataFrame) -> DataFrame:
    """Replaces ``body`` by ``route``: account / transaction / slot / unhandled / invalid."""
    return _typed(df, [c for c in df.columns if c != "body"], {"route": _route(F.col("v"))})


def _notified(df: DataFrame, route: str, cols: dict[str, Column]) -> DataFrame:
    """Complete rows of one route; the text is parsed once for routing and fields together."""
    routed = _typed(df, [], {"route": _route(F.col("v")), **cols}, list(cols))
    return routed.filter(F.col("route") == route)


def parse_account_notification(df: DataFrame) -> DataFrame:
    """Strict. Input ``body`` of any notification; other methods are left out."""
    v = F.col("v")
    cols = {"pubkey": J.text(v, "$.params[0]"), **_strict_account(v, "$.params[1].result")}
    return _notified(df, "account", cols).select(*cols)


def parse_signature_notification(df: DataFrame) -> DataFrame:
    """Strict. Fields the message does not carry (fee, block time) are NULL."""
    v = F.col("v")
    cols = {
        "signature": J.text(v, "$.params[0]"),
        "slot": J.u64_as_long(v, "$.params[1].result.context.slot"),
        "err": F.when(J.present(v, "$.params[1].result.value"), F.coalesce(~J.is_null(v, "$.params[1].result.value.err"), F.lit(False))),
    }
    return _notified(df, "transaction", cols).select(
        *cols,
        F.when(F.col("err"), 0).otherwise(1).cast("bigint").alias("status"),
        F.lit(None).cast("decimal(20,0)").alias("fee"),
        F.lit(None).cast("bigint").alias("block_time"),
    )


def parse_slot_notification(df: DataFrame) -> DataFrame:
    """Slot and parent; hashes are unknown at that point, so they are NULL."""
    return _notified(df, "slot", {"slot": J.u64_as_long(F.col("v"), "$.params[0]")}).select(
        "slot",
        saturating_prev_slot("slot").alias("parent_slot"),
        F.col("slot").alias("block_height"),
        F.lit(None).cast("string").alias("blockhash"),
        F.lit(None).cast("string").alias("parent_blockhash"),
    )
