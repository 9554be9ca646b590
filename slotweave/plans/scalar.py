"""Scalar functions over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.functions import scalars as X
from slotweave.operators.filters import validate_slot_status
from slotweave.plans.oracle_views import oracle
from slotweave.plans.reads import PROGRAM, type_sql
from slotweave.plans.registry import query

NOW = 1706000000


@query("x1_lamports_to_sol", oracle("v_account_updates", "SELECT seq, lamports / 1e9 AS sol FROM v_account_updates"))
def lamports_to_sol(v):
    return v.account_updates.select("seq", X.lamports_to_sol("lamports").alias("sol"))


@query(
    "x2_format_sol",
    oracle("v_transactions", """
        SELECT signature,
               format('{:,}', f // 1000000000) || '.' || CASE WHEN length(rtrim(frac, '0')) < 4 THEN substr(frac, 1, 4)
                    ELSE rtrim(frac, '0') END || ' SOL' AS short,
               format('{:,}', f // 1000000000) || '.' || frac || ' SOL' AS full,
               CASE WHEN err IS NULL THEN 'N/A' ELSE format('{:,}', f // 1000000000) || '.' || frac || ' SOL' END AS optional
        FROM (SELECT *, lpad(CAST(f % 1000000000 AS VARCHAR), 9, '0') AS frac FROM (SELECT *, fee * 1000 AS f FROM v_transactions))"""),
)
def format_sol(v):
    f = F.col("fee") * 1000
    return v.transactions.select(
        "signature", X.format_sol(f).alias("short"), X.format_sol(f, 9, 9).alias("full"),
        X.format_sol(F.when(F.col("err").isNotNull(), f), 9, 9).alias("optional"),
    )


@query(
    "x3_truncate_key",
    oracle("v_votes", "SELECT seq, left(block_hash, 4) || '...' || right(block_hash, 4) AS short FROM v_votes"),
)
def truncate_key(v):
    return v.votes.select("seq", X.truncate_key("block_hash").alias("short"))


@query(
    "x4_format_timestamp",
    oracle("v_transactions", """
        SELECT signature, strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS text FROM v_transactions"""),
)
def format_timestamp(v):
    return v.transactions.select("signature", X.format_timestamp("block_time").alias("text"))


@query(
    "x5_unix_to_datetime",
    oracle("v_transactions", "SELECT signature, year(make_timestamp(block_time * 1000000)) AS y, dayofyear(make_timestamp(block_time * 1000000)) AS d FROM v_transactions"),
)
def unix_to_datetime(v):
    t = X.unix_to_datetime("block_time")
    return v.transactions.select("signature", F.year(t).cast("bigint").alias("y"), F.dayofyear(t).cast("bigint").alias("d"))


@query(
    "x6_duration_since",
    oracle("v_account_updates", f"""
        SELECT seq, greatest({NOW} - CAST(floor(epoch(updated_at)) AS BIGINT), 0) AS age FROM v_account_updates"""),
)
def duration_since(v):
    return v.account_updates.select("seq", X.duration_since(F.unix_timestamp("updated_at"), NOW).alias("age"))


@query("x7_sha256_message", oracle("v_account_updates", "SELECT seq, sha256(pubkey || ':' || seq) AS digest FROM v_account_updates"))
def sha256(v):
    return v.account_updates.select("seq", X.sha256_message(F.encode(F.concat_ws(":", "pubkey", F.col("seq").cast("string")), "UTF-8")).alias("digest"))


@query("x8_hex_hash", oracle("v_account_updates", "SELECT seq, lower(hex(encode(owner || seq))) AS hex FROM v_account_updates"))
def hex_hash(v):
    return v.account_updates.select("seq", X.hex_hash(F.encode(F.concat("owner", F.col("seq").cast("string")), "UTF-8")).alias("hex"))


@query("x9_is_valid_pubkey", oracle("v_account_updates", "SELECT seq, seq % 3 = 0 AS valid FROM v_account_updates"))
def is_valid_pubkey(v):
    digest = F.unhex(F.sha2("pubkey", 256))
    raw = F.when(F.col("seq") % 3 == 0, digest).otherwise(F.substring(digest, 1, 20))
    key = F.when(F.col("seq") % 3 == 2, F.col("pubkey")).otherwise(X.base58_encode(raw))
    return v.account_updates.select("seq", X.is_valid_pubkey(key).alias("valid"))


@query(
    "x10_validate_slot_status",
    oracle("v_account_updates", """
        SELECT seq, s AS status, s IN ('processed', 'dead', 'createdBank') AS valid,
               CASE WHEN s NOT IN ('processed', 'dead', 'createdBank') THEN 'Unknown slot status: ' || s END AS error
        FROM (SELECT seq, CASE owner WHEN 'click' THEN 'processed' WHEN 'view' THEN 'dead' WHEN 'error' THEN 'bogus'
                     WHEN 'signup' THEN 'Rooted' ELSE 'createdBank' END AS s FROM v_account_updates)"""),
)
def slot_status(v):
    o = F.col("owner")
    status = (
        F.when(o == "click", "processed").when(o == "view", "dead").when(o == "error", "bogus").when(o == "signup", "Rooted").otherwise("createdBank")
    )
    good, bad = validate_slot_status(v.account_updates.select("seq", status.alias("status")))
    none = F.lit(None).cast("string")
    return good.withColumns({"error": none, "valid": F.lit(True)}).unionByName(bad.withColumn("valid", F.lit(False)))


@query(
    "x11_tx_success",
    oracle("v_transactions", """
        SELECT signature, err IS NULL AS success, CASE WHEN err IS NULL THEN 1 ELSE 0 END AS rpc_code,
               CASE WHEN err IS NULL THEN 0 ELSE 1 END AS meta_code FROM v_transactions"""),
)
def tx_success(v):
    return v.transactions.select(
        "signature", X.tx_success().alias("success"), X.tx_status_code().alias("rpc_code"), X.tx_status_code(style="meta").alias("meta_code")
    )


@query(
    "x12_commitment_name",
    oracle("v_account_updates", """
        SELECT seq, CASE seq % 4 WHEN 0 THEN 'unconfirmed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'finalized' END AS name
        FROM v_account_updates"""),
)
def commitment(v):
    return v.account_updates.select("seq", X.commitment_name(F.col("seq") % 4).alias("name"))


@query("x13_instruction_type", oracle("v_transactions", "SELECT signature, type FROM typed", typed=type_sql(PROGRAM)))
def instruction_type(v):
    return v.transactions.select("signature", X.instruction_type("instructions", PROGRAM).alias("type"))


@query(
    "x14_account_role_flags",
    oracle("v_account_updates", "SELECT seq, seq % 4 >= 2 AS is_signer, seq % 2 = 1 AS is_writable FROM v_account_updates"),
)
def roles(v):
    return v.account_updates.select("seq", X.account_role_flags(F.col("seq") % 4).alias("r")).select("seq", "r.*")


@query(
    "x15_message_priority",
    oracle("v_operators", "SELECT operator, CASE WHEN stake > 0 THEN CAST(floor(log10(stake)) AS BIGINT) ELSE 0 END AS priority FROM v_operators"),
)
def priority(v):
    return v.operators.select("operator", X.message_priority("stake").alias("priority"))


@query(
    "x16_reward_amount",
    oracle("v_scores", """
        SELECT seq, CAST(floor(CAST(0.1 AS DOUBLE) * score * CASE WHEN seq % 2 = 0 THEN CAST(1.5 AS DOUBLE) ELSE 1 END) AS BIGINT) AS reward
        FROM v_scores"""),
)
def reward(v):
    multiplier = F.when(F.col("seq") % 2 == 0, 1.5)
    return v.scores.select("seq", X.reward_amount("score", multiplier).cast("bigint").alias("reward"))


@query(
    "x17_split_commission",
    oracle("v_transactions", """
        SELECT signature, c AS commission, fee - c AS net
        FROM (SELECT signature, fee, CAST(floor(CAST(fee AS DOUBLE) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS c FROM v_transactions)"""),
)
def commission(v):
    return v.transactions.select("signature", X.split_commission("fee").alias("s")).select(
        "signature", F.col("s.commission").cast("bigint").alias("commission"), F.col("s.net").cast("bigint").alias("net")
    )


@query("x18_saturating_prev_slot", oracle("v_account_updates", "SELECT seq, greatest(slot - 1, 0) AS prev FROM v_account_updates"))
def prev_slot(v):
    return v.account_updates.select("seq", X.saturating_prev_slot("slot").alias("prev"))


@query(
    "x19_key_data",
    oracle("v_account_updates", """
        SELECT seq, CASE seq % 4
            WHEN 0 THEN format('{:,}', lamports // 1000000000) || '.' || CASE WHEN length(rtrim(frac, '0')) < 4 THEN substr(frac, 1, 4) ELSE rtrim(frac, '0') END || ' SOL'
            WHEN 1 THEN CASE WHEN slot > 0 THEN 'Slot: ' || slot ELSE 'No data' END
            WHEN 2 THEN write_version || ' tokens' ELSE 'No data' END AS text
        FROM (SELECT *, lpad(CAST(lamports % 1000000000 AS VARCHAR), 9, '0') AS frac FROM v_account_updates)"""),
)
def key_data(v):
    part = F.col("seq") % 4
    kind = F.when(part == 0, "account").when(part == 1, "transaction").when(part == 2, "token").otherwise("other")
    return v.account_updates.select("seq", X.key_data(kind, "lamports", "slot", "write_version").alias("text"))


@query(
    "x20_token_ui_amount",
    oracle("v_token_balances", "SELECT mint, round(amount / pow(10.0::DOUBLE, decimals), 6) AS ui_amount FROM v_token_balances"),
)
def ui_amount(v):
    return v.token_balances.select("mint", F.round(X.token_ui_amount("amount", "decimals"), 6).alias("ui_amount"))


@query(
    "x21_probe_status",
    oracle("v_health_probes", """
        SELECT seq, CASE probe WHEN 'ok' THEN 'healthy' WHEN 'http_error' THEN 'degraded' ELSE 'unhealthy' END AS status FROM v_health_probes"""),
)
def probe(v):
    return v.health_probes.select("seq", X.probe_status("probe").alias("status"))


@query(
    "x22_severity_penalty",
    oracle("v_violations", """
        SELECT seq, CASE violation WHEN 'LowUptime' THEN 0.5 WHEN 'DoubleProposal' THEN 0.7 WHEN 'DoubleVote' THEN 0.8 ELSE 1.0 END::DOUBLE AS severity,
               CASE violation WHEN 'LowUptime' THEN 1000 WHEN 'DoubleProposal' THEN 5000 WHEN 'DoubleVote' THEN 7500 ELSE 10000 END AS penalty
        FROM v_violations"""),
)
def penalties(v):
    return v.violations.select("seq", X.severity("violation").cast("double").alias("severity"), X.base_penalty("violation").alias("penalty"))


@query("x23_tag_source", oracle("v_account_updates", "SELECT seq, 'validator-1' AS validator_id FROM v_account_updates"))
def tag(v):
    return X.tag_source(v.account_updates.select("seq"), "validator-1")
