"""Selectors and predicates. Everything here is stateless, so it works on streams as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.scalars import is_recent, slot_status_valid

LONG_LIST = 1000  # beyond this a key list becomes a table and a join, not an IN list
BROADCAST_BYTES = 32 << 20  # key lists up to this size are broadcast, longer ones are shuffled


def _flag_join(df: DataFrame, column: str, keys: list[str], flag: str) -> DataFrame:
    distinct = sorted(set(keys))
    lookup = df.sparkSession.createDataFrame([(k,) for k in distinct], f"{flag}_key string")
    if sum(len(k.encode()) + 16 for k in distinct) <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    joined = df.join(lookup, F.col(column) == F.col(f"{flag}_key"), "left")
    return joined.withColumn(flag, F.col(f"{flag}_key").isNotNull()).drop(f"{flag}_key")


def _any_in(df: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Rows where any of the columns is in its key list."""
    kept = [(c, ks) for c, ks in rules if ks]
    if not kept:
        return df.limit(0)
    if sum(len(ks) for _, ks in kept) <= LONG_LIST:
        test = F.lit(False)
        for c, ks in kept:
            test = test | F.col(c).isin(ks)
        return df.filter(test)
    flags = []
    out = df
    for i, (c, ks) in enumerate(kept):
        flags.append(f"_hit{i}")
        out = _flag_join(out, c, ks, flags[-1])
    test = F.lit(False)
    for f in flags:
        test = test | F.col(f)
    return out.filter(test).drop(*flags)


def select_accounts(df: DataFrame, accounts: list[str] | None, owners: list[str] | None = None) -> DataFrame:
    """``"*"`` keeps all; otherwise a row stays if its key or its owner is listed.
    Without a selector (``accounts=None``) nothing is kept."""
    if accounts is None:
        return df.limit(0)
    if "*" in accounts:
        return df
    return _any_in(df, [("pubkey", accounts), ("owner", owners or [])])


def select_transactions(df: DataFrame, mentions: list[str] | None, include_votes: bool = False) -> DataFrame:
    """``"*"`` keeps all, ``"all_votes"`` the votes; otherwise any mentioned account keeps a row."""
    if mentions is None:
        return df.limit(0)
    if "*" in mentions:
        return df
    votes = include_votes or "all_votes" in mentions
    test = F.col("is_vote") if votes else F.lit(False)
    if "all_votes" not in mentions and mentions:
        test = test | F.arrays_overlap("accounts", F.array(*[F.lit(m) for m in mentions]))
    return df.filter(test)


def filter_account_updates(df: DataFrame, pubkeys: str | list[str] = "", program: str | None = None) -> DataFrame:
    """An empty key list means all keys; ``program`` must own the account when given."""
    keys = [k for k in pubkeys.split(",") if k] if isinstance(pubkeys, str) else list(pubkeys)
    out = _any_in(df, [("pubkey", keys)]) if keys else df
    return out if program is None else out.filter(F.col("owner") == program)


def filter_transaction_updates(df: DataFrame, program: str | None = None, account: str | None = None) -> DataFrame:
    out = df
    if program is not None:
        out = out.filter(F.array_contains("program_ids", program))
    if account is not None:
        out = out.filter(F.array_contains("accounts", account))
    return out


def relevant_to_program(df: DataFrame, program: str) -> DataFrame:
    return df.filter(F.array_contains("program_ids", program) | F.array_contains("accounts", program))


def accounts_by_program(df: DataFrame, program: str, limit: int = 10) -> DataFrame:
    return df.filter(F.col("owner") == program).orderBy("pubkey").limit(limit)


def slot_range(
    df: DataFrame, lo: int, hi: int, limit: int | None = None, order: list[str] | None = None, width: int | None = None
) -> DataFrame:
    """Inclusive slot range. With ``width`` the predicate is also put on ``slot_bucket`` so that
    partition pruning applies; with ``limit`` the first rows by slot, write version."""
    test = F.col("slot").between(lo, hi)
    if width is not None and "slot_bucket" in df.columns:
        test = test & F.col("slot_bucket").between(lo // width, hi // width)
    out = df.filter(test)
    if limit is not None:
        out = out.orderBy(*(order or ["slot", "write_version"])).limit(limit)
    return out


def get_by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup: no row or one row."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def recent_rows(df: DataFrame, seconds: str, max_age: int, now: int | Column) -> DataFrame:
    return df.filter(is_recent(seconds, max_age, now))


def min_stake_filter(df: DataFrame, minimum: int, stake: str = "stake") -> DataFrame:
    """All rows with ``accepted`` and, for the rejected ones, a ``reason``."""
    low = F.col(stake).isNull() | (F.col(stake) < minimum)
    return df.withColumns({"accepted": ~low, "reason": F.when(low, "stake below minimum")})


def active_operators(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def split_startup(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows and live updates."""
    return df.filter("is_startup"), df.filter(~F.col("is_startup"))


def check_uptime(df: DataFrame, min_uptime: float, uptime: str = "uptime") -> DataFrame:
    return df.withColumn("uptime_ok", F.col(uptime) >= min_uptime)


def validate_slot_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with one of the known status names, and the rest with an error text."""
    ok = slot_status_valid("status")
    bad = df.filter(~ok).withColumn("error", F.concat(F.lit("Unknown slot status: "), F.coalesce("status", F.lit(""))))
    return df.filter(ok), bad


