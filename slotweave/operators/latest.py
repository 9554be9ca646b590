"""Latest-state tables. ``max_by`` keeps one row per key and combines map-side, so a key with very
many versions costs no large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _extreme(df: DataFrame, keys: list[str], pick, order: Column) -> DataFrame:
    """One row per key. Keys come from the grouping, so a filter on a key is pushed below it."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(pick(rest, order).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key; end ``order`` with something unique."""
    return _extreme(df, keys, F.max_by, order)


def earliest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _extreme(df, keys, F.min_by, order)


def upsert_accounts(base: DataFrame | None, updates: DataFrame, tie: str = "write_version") -> DataFrame:
    """Accounts after applying ``updates``: the highest slot wins.

    At equal slots the higher write version wins and then the later arrival (``seq``), or with
    ``tie="arrival"`` the later arrival alone. Stored rows without ``seq`` count as earlier.
    """
    rows = updates if base is None else base.unionByName(updates, allowMissingColumns=True)
    order = ["slot", "write_version", "seq"] if tie == "write_version" else ["slot", "seq"]
    return latest_by(rows, ["pubkey"], F.struct(*order))


def upsert_latest(base: DataFrame | None, updates: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Last arrival wins: transactions by signature, blocks by slot, cached values by key."""
    rows = updates if base is None else base.unionByName(updates, allowMissingColumns=True)
    return latest_by(rows, [key], F.struct(seq))


def latest_metrics(df: DataFrame, key: str = "key", time: str = "ts", seq: str = "seq") -> DataFrame:
    """Gauges: the last value of every key."""
    return latest_by(df, [key], F.struct(time, seq))


def operator_status(operators: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last activity flag and time per known operator, and the updates of unknown ones as errors."""
    last = updates.groupBy("operator").agg(
        F.max_by(F.struct("is_active", F.col("seen_at").alias("last_seen")), "seq").alias("_last")
    ).select("operator", "_last.*")
    known = operators.select("operator")
    return last.join(known, "operator", "left_semi"), updates.join(known, "operator", "left_anti").withColumn(
        "error", F.concat(F.lit("Operator not found: "), "operator")
    )


def last_votes(votes: DataFrame, time: str = "seq") -> DataFrame:
    """Time of the last vote per validator."""
    return votes.groupBy("validator").agg(F.max(time).alias("last_vote"))
