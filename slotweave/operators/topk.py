"""Newest, largest, paged. Every ``orderBy().limit()`` runs as a top-k per partition and one merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions.scalars import instruction_type

PAGE_DEFAULT = 10


def recent(df: DataFrame, n: int, time: str = "updated_at", key: str = "pubkey") -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key)).limit(n)


def recent_transactions(df: DataFrame, n: int = 10, order: list[str] = ["slot", "idx"]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def latest_block(df: DataFrame) -> DataFrame:
    return df.agg(F.max_by(F.struct(*df.columns), "slot").alias("_row")).filter("_row IS NOT NULL").select("_row.*")


def retain_latest_slots(df: DataFrame, trigger: int = 1000, keep: int = 500) -> DataFrame:
    """All rows while there are at most ``trigger`` slots; beyond that those of the ``keep`` highest slots."""
    slots = df.agg(F.count_distinct("slot").alias("n"))
    cut = df.select("slot").distinct().orderBy(F.col("slot").desc()).limit(keep).agg(F.min("slot").alias("cut"))
    return df.filter((slots.scalar() <= trigger) | (F.col("slot") >= cut.scalar()))


def sort_watchlist(df: DataFrame, field: str = "added", direction: str = "desc") -> DataFrame:
    """By added / name (the key where there is no name) / type, in byte order; then by id."""
    column = {"added": F.col("added"), "name": F.coalesce("name", "pubkey"), "type": F.col("type")}[field]
    return df.orderBy(column.asc() if direction == "asc" else column.desc(), "id")


def largest_accounts(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(F.col("lamports").desc(), "pubkey").limit(n)


def page(
    df: DataFrame, key: str, limit: int = PAGE_DEFAULT, before: object = None, after: object = None, max_limit: int | None = None
) -> DataFrame:
    """Keyset page, newest key first; the key predicates reach the scan. A ``limit`` above ``max_limit`` is an error."""
    if max_limit is not None and limit > max_limit:
        raise ValueError(f"at most {max_limit} rows a page")
    out = df
    if before is not None:
        out = out.filter(F.col(key) < F.lit(before))
    if after is not None:
        out = out.filter(F.col(key) > F.lit(after))
    return out.orderBy(F.col(key).desc()).limit(limit)


def mentions(program: str):
    """Whether a transaction calls a program or lists it; as ``where`` of ``sources.tables.read_newest``, its rows are all that ``tracker_view`` needs."""
    return F.array_contains("program_ids", program) | F.array_contains("accounts", program)


def tracker_view(tx: DataFrame, program: str, keep: int = 100, show: int = 20, order: list[str] = ["slot", "idx"]) -> DataFrame:
    """The newest ``keep`` transactions of a program with their type; ``shown`` marks the newest ``show``."""
    desc = [F.col(c).desc() for c in order]
    mine = tx.filter(mentions(program))
    kept = mine.orderBy(*desc).limit(keep)
    rank = F.row_number().over(W.orderBy(*desc))  # over the ``keep`` rows only
    return kept.withColumns({"instruction_type": instruction_type("instructions", program), "shown": rank <= show})
