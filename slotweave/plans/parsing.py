"""JSON text to typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.operators import parse as P
from slotweave.plans.oracle_views import oracle
from slotweave.plans.reads import RPC_STATUS
from slotweave.plans.registry import query
from slotweave.sources.tables import normalize_versions

NOW = 1700000000


def _doc(view: str, keys: str = "") -> str:
    """CTE: the view with broken JSON replaced by an empty document, flagged in ``ok``."""
    return f"SELECT {keys} CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS j, json_valid(body) AS ok FROM {view}"


def _u64(path: str, doc: str = "j") -> str:
    return f"CASE WHEN json_type({doc}, '{path}') = 'UBIGINT' THEN CAST(json_extract_string({doc}, '{path}') AS UBIGINT) END"


def _i64(path: str, doc: str = "j") -> str:
    return f"CASE WHEN json_type({doc}, '{path}') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string({doc}, '{path}') AS BIGINT) END"


def _text(path: str, doc: str = "j") -> str:
    return f"CASE WHEN json_type({doc}, '{path}') = 'VARCHAR' THEN json_extract_string({doc}, '{path}') END"


def _bool(path: str, doc: str = "j") -> str:
    return f"CASE WHEN json_type({doc}, '{path}') = 'BOOLEAN' THEN json_extract_string({doc}, '{path}') = 'true' END"


def _account(root: str) -> str:
    return f"""{_u64(root + '.value.lamports')} AS lamports, {_text(root + '.value.owner')} AS owner,
        {_bool(root + '.value.executable')} AS executable, {_u64(root + '.value.rentEpoch')} AS rent_epoch,
        TRY(from_base64({_text(root + '.value.data[0]')})) AS data, {_u64(root + '.context.slot')} AS slot"""


ACCOUNT_OUT = """pubkey, CAST(lamports AS BIGINT) AS lamports, owner, executable, CAST(rent_epoch AS VARCHAR) AS rent_epoch,
    CAST(slot AS BIGINT) AS slot, decode(data) AS data"""
COMPLETE = "lamports IS NOT NULL AND owner IS NOT NULL AND executable IS NOT NULL AND rent_epoch IS NOT NULL AND data IS NOT NULL AND slot IS NOT NULL"


def _account_out(df):
    return df.select(
        "pubkey", F.col("lamports").cast("bigint").alias("lamports"), "owner", "executable",
        F.col("rent_epoch").cast("string").alias("rent_epoch"), "slot", F.decode("data", "UTF-8").alias("data"),
    )


@query(
    "j1_parse_account_response",
    oracle("v_account_rpc", f"SELECT {ACCOUNT_OUT} FROM p WHERE {COMPLETE}",
           d=_doc("v_account_rpc", "pubkey,"), p=f"SELECT pubkey, {_account('$.result')} FROM d"),
)
def account_response(v):
    return _account_out(P.parse_account_response(v.account_rpc))


@query(
    "j2_parse_account_notification",
    oracle("v_notifications", f"SELECT {ACCOUNT_OUT} FROM p WHERE {COMPLETE} AND pubkey IS NOT NULL",
           d=_doc("v_notifications"),
           p=f"""SELECT {_text('$.params[0]')} AS pubkey, {_account('$.params[1].result')} FROM d
                 WHERE json_extract_string(j, '$.method') = 'accountNotification'"""),
)
def account_notification(v):
    return _account_out(P.parse_account_notification(v.notifications))


def _logs_sql(default: str) -> str:
    return f"""CASE WHEN json_type(j, '$.result.meta.logMessages') = 'ARRAY' THEN array_to_string(list_transform(
        CAST(json_extract(j, '$.result.meta.logMessages') AS JSON[]), lambda x:
        CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE {default} END), '|') END"""


@query(
    "j3_parse_transaction_response",
    oracle("v_transaction_rpc", """
        SELECT signature, CAST(slot AS BIGINT) AS slot, err, CAST(fee AS BIGINT) AS fee, block_time, logs,
               CASE WHEN err THEN 0 ELSE 1 END AS status
        FROM p WHERE slot IS NOT NULL AND fee IS NOT NULL""",
        d=_doc("v_transaction_rpc", "signature,"),
        p=f"""SELECT signature, {_u64('$.result.slot')} AS slot, {_u64('$.result.meta.fee')} AS fee,
                {_i64('$.result.blockTime')} AS block_time,
                coalesce(json_type(j, '$.result.meta.err') <> 'NULL', false) AS err,
                coalesce({_logs_sql('NULL')}, '') AS logs FROM d"""),
)
def transaction_response(v):
    return P.parse_transaction_response(v.transaction_rpc).select(
        "signature", "slot", "err", F.col("fee").cast("bigint").alias("fee"), "block_time", "status",
        F.array_join("log_messages", "|").alias("logs"),
    )


@query(
    "j4_parse_signature_notification",
    oracle("v_notifications", """
        SELECT signature, CAST(slot AS BIGINT) AS slot, err, CASE WHEN err THEN 0 ELSE 1 END AS status
        FROM p WHERE signature IS NOT NULL AND slot IS NOT NULL""",
        d=_doc("v_notifications"),
        p=f"""SELECT {_text('$.params[0]')} AS signature, {_u64('$.params[1].result.context.slot')} AS slot,
                coalesce(json_type(j, '$.params[1].result.value.err') <> 'NULL', false) AS err
              FROM d WHERE json_extract_string(j, '$.method') = 'signatureNotification'
                AND json_exists(j, '$.params[1].result.value')"""),
)
def signature_notification(v):
    return P.parse_signature_notification(v.notifications).select("signature", "slot", "err", "status")


@query(
    "j5_parse_block_response",
    oracle("v_block_rpc", """
        SELECT * FROM p WHERE blockhash IS NOT NULL AND parent_slot IS NOT NULL AND parent_blockhash IS NOT NULL
            AND transaction_count IS NOT NULL""",
        d=_doc("v_block_rpc", "slot,"),
        p=f"""SELECT slot, {_text('$.result.blockhash')} AS blockhash, CAST({_u64('$.result.parentSlot')} AS BIGINT) AS parent_slot,
                {_text('$.result.previousBlockhash')} AS parent_blockhash, {_i64('$.result.blockTime')} AS block_time,
                CAST({_u64('$.result.blockHeight')} AS BIGINT) AS block_height,
                CASE WHEN json_type(j, '$.result.transactions') = 'ARRAY'
                     THEN CAST(json_array_length(j, '$.result.transactions') AS BIGINT) END AS transaction_count
              FROM d"""),
)
def block_response(v):
    return P.parse_block_response(v.block_rpc)


@query(
    "j6_parse_slot_notification",
    oracle("v_notifications", """
        SELECT CAST(slot AS BIGINT) AS slot, greatest(CAST(slot AS BIGINT) - 1, 0) AS parent_slot FROM p WHERE slot IS NOT NULL""",
        d=_doc("v_notifications"),
        p=f"SELECT {_u64('$.params[0]')} AS slot FROM d WHERE json_extract_string(j, '$.method') = 'slotNotification'"),
)
def slot_notification(v):
    return P.parse_slot_notification(v.notifications).select("slot", "parent_slot")


@query(
    "j7_parse_account_lenient",
    oracle("v_account_rpc", f"""
        SELECT seq, pubkey, rpc_status, CASE WHEN good THEN lamports END AS lamports, CASE WHEN good THEN owner END AS owner,
               CASE WHEN good THEN executable END AS executable, CASE WHEN good THEN rent_epoch END AS rent_epoch,
               CASE WHEN good THEN data_base64 END AS data_base64, CASE WHEN good THEN slot END AS slot
        FROM (SELECT *, rpc_status = 'ok' AS good FROM p)""",
        d=_doc("v_account_rpc", "seq, pubkey,"),
        p=f"""SELECT seq, pubkey,
                CASE WHEN NOT ok THEN 'invalid' WHEN NOT json_exists(j, '$.result') THEN 'missing_result'
                     WHEN NOT json_exists(j, '$.result.context') THEN 'missing_context'
                     WHEN NOT json_exists(j, '$.result.value') THEN 'missing_value'
                     WHEN json_type(j, '$.result.value') = 'NULL' THEN 'not_found' ELSE 'ok' END AS rpc_status,
                CAST(coalesce({_u64('$.result.value.lamports')}, 0) AS BIGINT) AS lamports,
                coalesce({_text('$.result.value.owner')}, '') AS owner,
                coalesce({_bool('$.result.value.executable')}, false) AS executable,
                CAST(coalesce({_u64('$.result.value.rentEpoch')}, 0) AS VARCHAR) AS rent_epoch,
                CASE WHEN json_type(j, '$.result.value.data') = 'ARRAY' AND json_array_length(j, '$.result.value.data') >= 2
                     THEN coalesce({_text('$.result.value.data[0]')}, '') END AS data_base64,
                CAST(coalesce({_u64('$.result.context.slot')}, 0) AS BIGINT) AS slot
              FROM d"""),
)
def account_lenient(v):
    return P.parse_account(v.account_rpc).withColumns(
        {"lamports": F.col("lamports").cast("bigint"), "rent_epoch": F.col("rent_epoch").cast("string")}
    )


MSG = "$.result.transaction.message"


@query(
    "j8_parse_transaction_full",
    oracle("v_transaction_rpc", """
        SELECT signature, CAST(slot AS BIGINT) AS slot, block_time, err, CAST(fee AS BIGINT) AS fee, recent_blockhash,
               array_to_string(CASE WHEN ins IS NULL THEN keys
                    ELSE list_filter(list_transform(ins, lambda i: json_extract_string(i, '$.programId')), lambda x: x IS NOT NULL) END, ',')
                   AS program_ids,
               array_to_string(keys, ',') AS accounts, logs,
               array_to_string(list_transform(
                   list_filter(coalesce(ins, []), lambda i: json_exists(i, '$.programId')),
                   lambda i: json_extract_string(i, '$.programId') || ':' || json_extract_string(i, '$.data') || ':'
                       || coalesce(array_to_string(list_filter(list_transform(
                            CAST(json_extract(i, '$.accounts') AS BIGINT[]), lambda n: keys[n + 1]), lambda k: k IS NOT NULL), '+'), '')
               ), ',') AS instructions,
               err IS NULL AS success
        FROM p WHERE slot IS NOT NULL AND fee IS NOT NULL""",
        d=_doc("v_transaction_rpc", "signature,"),
        p=f"""SELECT signature, {_u64('$.result.slot')} AS slot, {_u64('$.result.meta.fee')} AS fee,
                {_i64('$.result.blockTime')} AS block_time,
                CASE WHEN json_type(j, '$.result.meta.err') <> 'NULL' THEN CAST(json_extract(j, '$.result.meta.err') AS VARCHAR) END AS err,
                coalesce({_text(MSG + '.recentBlockhash')}, '') AS recent_blockhash,
                CAST(json_extract(j, '{MSG}.accountKeys') AS VARCHAR[]) AS keys,
                {_logs_sql("''")} AS logs,
                CAST(json_extract(j, '{MSG}.instructions') AS JSON[]) AS ins
              FROM d WHERE NOT json_exists(j, '$.error') AND json_exists(j, '{MSG}')"""),
)
def transaction_full(v):
    one = lambda i: F.concat_ws(":", i["program_id"], i["data"], F.array_join(i["accounts"], "+"))
    return P.parse_transaction_full(v.transaction_rpc).select(
        "signature", "slot", "block_time", "err", F.col("fee").cast("bigint").alias("fee"), "recent_blockhash",
        F.array_join("program_ids", ",").alias("program_ids"), F.array_join("accounts", ",").alias("accounts"),
        F.array_join("logs", "|").alias("logs"), F.array_join(F.transform("instructions", one), ",").alias("instructions"),
        "success",
    )


@query(
    "j9_parse_block_full",
    oracle("v_block_rpc", f"""
        SELECT slot, parent_slot, blockhash, previous_blockhash, block_time, block_height, transaction_count,
               coalesce(json_extract_string(list_filter(rw, lambda r: json_extract_string(r, '$.rewardType') = 'fee')[1], '$.pubkey'),
                        '11111111111111111111111111111111') AS leader,
               CAST(len(whole) AS BIGINT) AS rewards,
               CAST(coalesce(list_sum(list_transform(whole, lambda r: CAST(json_extract_string(r, '$.lamports') AS BIGINT))), 0) AS BIGINT) AS reward_sum
        FROM (SELECT *, list_filter(rw, lambda r: json_exists(r, '$.pubkey') AND json_exists(r, '$.lamports')
                     AND json_exists(r, '$.postBalance') AND json_exists(r, '$.rewardType')) AS whole
              FROM (SELECT *, coalesce(parent, greatest(slot - 1, 0)) AS parent_slot FROM p))""",
        d=_doc("v_block_rpc"),
        p=f"""SELECT CAST(coalesce({_u64('$.result.slot')}, 0) AS BIGINT) AS slot,
                CAST({_u64('$.result.parentSlot')} AS BIGINT) AS parent,
                coalesce({_text('$.result.blockhash')}, 'unknown') AS blockhash,
                coalesce({_text('$.result.previousBlockhash')}, 'unknown') AS previous_blockhash,
                coalesce({_i64('$.result.blockTime')}, {NOW}) AS block_time,
                CAST(coalesce({_u64('$.result.blockHeight')}, 0) AS BIGINT) AS block_height,
                CASE WHEN json_type(j, '$.result.transactions') = 'ARRAY'
                     THEN CAST(json_array_length(j, '$.result.transactions') AS BIGINT) ELSE 0 END AS transaction_count,
                CASE WHEN json_type(j, '$.result.rewards') = 'ARRAY' THEN CAST(json_extract(j, '$.result.rewards') AS JSON[]) ELSE [] END AS rw
              FROM d WHERE ok AND NOT json_exists(j, '$.error') AND json_exists(j, '$.result')"""),
)
def block_full(v):
    total = F.aggregate("rewards", F.lit(0).cast("bigint"), lambda a, r: a + r["lamports"])
    return P.parse_block_full(v.block_rpc, NOW).withColumns(
        {"reward_sum": total, "rewards": F.array_size("rewards").cast("bigint")}
    )


@query(
    "j10_route_rpc",
    oracle("v_transaction_rpc", f"SELECT signature, {RPC_STATUS} AS rpc_status FROM v_transaction_rpc"),
)
def route_rpc(v):
    return P.route_rpc(v.transaction_rpc)


@query(
    "j11_route_notification",
    oracle("v_notifications", """
        SELECT seq, CASE WHEN NOT ok THEN 'invalid'
                ELSE CASE json_extract_string(j, '$.method') WHEN 'accountNotification' THEN 'account'
                     WHEN 'signatureNotification' THEN 'transaction' WHEN 'slotNotification' THEN 'slot'
                     ELSE 'unhandled' END END AS route
        FROM d""", d=_doc("v_notifications", "seq,")),
)
def route_notification(v):
    return P.route_notification(v.notifications)


@query(
    "j12_normalize_versions",
    oracle("v_account_updates", """
        SELECT pubkey, owner, lamports, slot, CASE WHEN seq % 3 > 0 THEN write_version END AS write_version,
               CASE WHEN seq % 3 = 2 THEN 'sig' || seq END AS transaction_signature
        FROM v_account_updates"""),
)
def normalize(v):
    rows = v.account_updates
    part = F.col("seq") % 3
    v1 = rows.filter(part == 0).drop("write_version")
    v2 = rows.filter(part == 1)
    v3 = rows.filter(part == 2).withColumn("transaction_signature", F.concat(F.lit("sig"), "seq"))
    return normalize_versions("accounts", v1, v2, v3).select(
        "pubkey", "owner", F.col("lamports").cast("bigint").alias("lamports"), "slot", "write_version", "transaction_signature"
    )
