"""Scalar expressions on single rows. All but the exact base58 test stay inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions.json import U64_MAX

LAMPORTS_PER_SOL = 1e9
SYSTEM_ID = "11111111111111111111111111111111"

# Slot status names, instruction codes, violation weights, commitment levels.
SLOT_STATUSES = [
    "processed", "confirmed", "rooted", "firstShredReceived", "completed", "createdBank", "dead",
]
INSTRUCTION_NAMES = {
    "01000000": "Swap",
    "02000000": "Deposit",
    "03000000": "Withdraw",
    "04000000": "Create Position",
    "05000000": "Create Pool",
    "06000000": "Close Position",
    "07000000": "Collect Fees",
    "08000000": "Update Fees",
}
SEVERITY = {"LowUptime": "0.5", "DoubleProposal": "0.7", "DoubleVote": "0.8", "MaliciousValidation": "1.0"}
PENALTY = {"LowUptime": 1000, "DoubleProposal": 5000, "DoubleVote": 7500, "MaliciousValidation": 10000}
DEFAULT_PENALTY = 1000
COMMITMENT = {0: "unconfirmed", 1: "confirmed", 2: "finalized"}
BASE58_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(key: Column, table: dict, typ: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key).cast(typ)


# --- money ------------------------------------------------------------------------------------


def lamports_to_sol(lamports: str | Column) -> Column:
    return _col(lamports).cast("double") / F.lit(LAMPORTS_PER_SOL)


def format_sol(lamports: str | Column, min_digits: int = 4, max_digits: int = 9) -> Column:
    pattern = "#,##0." + "0" * min_digits + "#" * (max_digits - min_digits)
    sol = _col(lamports).cast("decimal(20,0)") / F.lit(10**9).cast("decimal(10,0)")
    return F.coalesce(F.concat(F.call_function("format_number", sol.cast("decimal(30,9)"), F.lit(pattern)), F.lit(" SOL")), F.lit("N/A"))


def token_ui_amount(amount: str | Column, decimals: str | Column) -> Column:
    return _col(amount).cast("double") / F.pow(F.lit(10.0), _col(decimals).cast("double"))


# --- keys and hashes --------------------------------------------------------------------------


def truncate_key(key: str | Column) -> Column:
    k = _col(key)
    short = F.concat(F.substring(k, 1, 4), F.lit("..."), F.right(k, F.lit(4)))
    return F.when(k.isNull() | (k == ""), "Unknown").otherwise(short)


def sha256_message(data: str | Column) -> Column:
    return F.sha2(_col(data), 256)


def hex_hash(data: str | Column) -> Column:
    return F.lower(F.hex(_col(data)))


def _decode58(text: str) -> bytes | None:
    n = 0
    for ch in text:
        digit = BASE58_ALPHABET.find(ch)
        if digit < 0:
            return None
        n = n * 58 + digit
    zeros = len(text) - len(text.lstrip("1"))
    return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _encode58(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58_ALPHABET[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


@F.pandas_udf(T.BooleanType())
def _is_32_bytes(keys: pd.Series) -> pd.Series:
    def check(key):
        raw = None if key is None else _decode58(key)
        return raw is not None and len(raw) == 32

    return keys.map(check)


@F.pandas_udf(T.StringType())
def base58_encode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else _encode58(bytes(b)))


def looks_like_pubkey(key: str | Column) -> Column:
    """Alphabet and length only; lets everything a 32-byte key can look like pass."""
    return F.coalesce(_col(key).rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$"), F.lit(False))


def is_valid_pubkey(key: str | Column) -> Column:
    """True for the base58 form of exactly 32 bytes. Only texts of the right shape reach Python."""
    k = _col(key)
    return looks_like_pubkey(k) & F.coalesce(_is_32_bytes(F.when(looks_like_pubkey(k), k)), F.lit(False))


# --- time -------------------------------------------------------------------------------------


def unix_to_datetime(seconds: str | Column) -> Column:
    return F.timestamp_seconds(_col(seconds))


def format_timestamp(seconds: str | Column) -> Column:
    return F.date_format(F.timestamp_seconds(_col(seconds)), "yyyy-MM-dd HH:mm:ss 'UTC'")


def duration_since(seconds: str | Column, now: int | Column) -> Column:
    now = F.lit(now) if isinstance(now, int) else now
    return F.greatest(now - _col(seconds), F.lit(0)).cast("bigint")


def is_recent(seconds: str | Column, max_age: int, now: int | Column) -> Column:
    return duration_since(seconds, now) <= max_age


# --- transactions and slots -------------------------------------------------------------------


def slot_status_valid(status: str | Column) -> Column:
    return F.coalesce(_col(status).isin(SLOT_STATUSES), F.lit(False))


def tx_success(err: str | Column = "err") -> Column:
    return _col(err).isNull()


def tx_status_code(err: str | Column = "err", style: str = "rpc") -> Column:
    """``rpc``: 1 is success. ``meta``: 0 is success."""
    good, bad = (1, 0) if style == "rpc" else (0, 1)
    return F.when(tx_success(err), F.lit(good)).otherwise(F.lit(bad)).cast("bigint")


def commitment_name(level: str | Column) -> Column:
    return _lookup(_col(level).cast("int"), COMMITMENT, "string")


def instruction_type(instructions: str | Column, program: str | Column | None) -> Column:
    """Name of the first instruction of ``program`` (a literal, or a column holding it)."""
    ins = _col(instructions)
    wanted = F.lit(program) if isinstance(program, str) else program
    first = F.get(F.filter(ins, lambda i: i["program_id"] == wanted), 0)
    name = _lookup(F.substring(first["data"], 1, 8), INSTRUCTION_NAMES, "string")
    return (
        F.when(ins.isNull() | (F.size(ins) == 0), "Unknown")
        .when(first.isNull(), "Other")
        .otherwise(F.coalesce(name, F.lit("Unknown Instruction")))
    )


def account_role_flags(role: str | Column) -> Column:
    """Role 0..3 as STRUCT<is_signer, is_writable>."""
    r = _col(role)
    return F.struct((r >= 2).alias("is_signer"), (r % 2 == 1).alias("is_writable"))


def saturating_prev_slot(slot: str | Column) -> Column:
    return F.greatest(_col(slot) - 1, F.lit(0)).cast("bigint")


def key_data(kind: str | Column, lamports: str | Column, slot: str | Column, tokens: str | Column) -> Column:
    """Summary text of a watched entity; zero and missing values read as no data."""
    k, sol, s, n = _col(kind), _col(lamports), _col(slot), _col(tokens)
    return (
        F.when((k == "account") & (sol > 0), format_sol(sol))
        .when((k == "transaction") & (s > 0), F.concat(F.lit("Slot: "), s.cast("string")))
        .when((k == "token") & n.isNotNull(), F.concat(n.cast("string"), F.lit(" tokens")))
        .otherwise("No data")
    )


def tag_source(df, validator_id: str):
    return df.withColumn("validator_id", F.lit(validator_id))


# --- staking ----------------------------------------------------------------------------------


def message_priority(stake: str | Column) -> Column:
    """Whole decimal magnitude of a stake; 0 for stake 0."""
    return F.coalesce(F.floor(F.log10(_col(stake).cast("double"))), F.lit(0)).cast("bigint")


def _saturating_u64(x: Column) -> Column:
    """Double to unsigned 64 bit: toward zero, NaN and negatives to 0, too large to the maximum."""
    top = F.lit(U64_MAX)
    return (
        F.when(x.isNull(), F.lit(None).cast("decimal(20,0)"))
        .when(F.isnan(x) | (x < 0), F.lit(0).cast("decimal(20,0)"))
        .when(x >= 1.8446744073709552e19, top)
        .when(x < 9.2e18, F.floor(F.least(x, F.lit(9.2e18))).cast("decimal(20,0)"))
        .otherwise(x.try_cast("decimal(20,0)"))
    )


def reward_amount(score: str | Column, multiplier: str | Column, base_rate: float = 0.10) -> Column:
    m = F.coalesce(_col(multiplier), F.lit(1.0))
    return _saturating_u64(F.lit(base_rate) * _col(score) * m)


def split_commission(amount: str | Column, rate: float = 0.10) -> Column:
    """STRUCT<commission, net>. The product is a double, as in the definition, then truncated."""
    a = _col(amount).cast("decimal(20,0)")
    commission = _saturating_u64(a.cast("double") * F.lit(rate))
    return F.struct(
        commission.alias("commission"), (a - commission).cast("decimal(20,0)").alias("net")
    )


def severity(violation: str | Column) -> Column:
    return _lookup(_col(violation), SEVERITY, "decimal(10,1)")


def base_penalty(violation: str | Column) -> Column:
    return F.coalesce(_lookup(_col(violation), PENALTY, "bigint"), F.lit(DEFAULT_PENALTY).cast("bigint"))


# --- service health ---------------------------------------------------------------------------


def probe_status(probe: str | Column) -> Column:
    """``ok`` is healthy, an HTTP error status degraded, no answer at all unhealthy."""
    p = _col(probe)
    return F.when(p == "ok", "healthy").when(p == "http_error", "degraded").otherwise("unhealthy")
