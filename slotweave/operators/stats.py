"""Statistics. All of them are hash aggregations with partial results before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions.scalars import instruction_type, tx_success


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("kind"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def ingest_rates(df: DataFrame, kind: str, seconds: str) -> DataFrame:
    """Rows per elapsed second per kind; 0 when no time has passed."""
    elapsed = (F.max(seconds) - F.min(seconds)).cast("double")
    return df.groupBy(kind).agg(
        F.count("*").alias("processed"),
        F.when(elapsed > 0, F.count("*") / elapsed).otherwise(F.lit(0.0)).alias("per_second"),
    )


def indexer_state(accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """One row: highest slot seen, number of accounts and of transactions."""
    both = accounts.select("slot", F.lit(1).alias("a"), F.lit(0).alias("t")).unionByName(
        tx.select("slot", F.lit(0).alias("a"), F.lit(1).alias("t"))
    )
    return both.agg(
        F.max("slot").alias("last_processed_slot"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_accounts"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("total_transactions"),
    )


def daily_stats(tx: DataFrame) -> DataFrame:
    """Per UTC day: transactions, success rate in percent, fees in SOL to 6 digits."""
    day = F.date_format(F.timestamp_seconds("block_time"), "yyyy-MM-dd")
    good = F.count(F.when(tx_success("err"), 1))
    return (
        tx.groupBy(day.alias("date"))
        .agg(
            F.count("*").alias("transactions"),
            (good / F.count("*") * 100).alias("success_rate"),
            F.round(F.sum("fee").cast("double") / 1e9, 6).alias("fees"),
        )
        .orderBy("date")
    )


def instruction_mix(tx: DataFrame, program: str) -> DataFrame:
    """Count and share in percent per instruction type of a program's transactions."""
    mine = tx.filter(F.array_contains("program_ids", program) | F.array_contains("accounts", program))
    counts = mine.groupBy(instruction_type("instructions", program).alias("name")).agg(F.count("*").alias("value"))
    total = F.sum("value").over(W.partitionBy())  # one row per type name, at most a dozen
    return counts.withColumn("percent", F.col("value") / total * 100)


def health_rollup(checks: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Status per service from its checks. With ``services`` a service without checks is healthy."""
    healthy = F.col("status") == "healthy"
    rolled = checks.groupBy("service").agg(
        F.when(F.bool_and(healthy), "healthy")
        .when(F.bool_or(F.col("status").isin("healthy", "degraded")), "degraded")
        .otherwise("unhealthy")
        .alias("status"),
        F.count("*").alias("checks"),
    )
    if services is None:
        return rolled
    return services.select("service").join(rolled, "service", "left").select(
        "service", F.coalesce("status", F.lit("healthy")).alias("status"), F.coalesce("checks", F.lit(0)).alias("checks")
    )


def pipeline_counters(events: DataFrame, kind: str = "kind") -> DataFrame:
    """Received, failed and published rows per kind; columns ``error`` and ``published`` are flags."""
    return events.groupBy(kind).agg(
        F.count("*").alias("received"), F.count_if("error").alias("errors"), F.count_if("published").alias("published")
    )


def block_summary(entries: DataFrame, rewards: DataFrame) -> DataFrame:
    """Per slot: entries, executed transactions, reward total and leader (key of the first fee reward
    by ``idx``). The many entries are summed by hash; both sides meet as one row per slot."""
    e = entries.groupBy("slot").agg(F.count("*").alias("entry_count"), F.sum("executed_transaction_count").alias("executed_tx"))
    fee_idx = F.when(F.col("reward_type") == "fee", F.col("idx"))
    r = rewards.groupBy("slot").agg(F.sum("lamports").alias("rewards"), F.min_by("pubkey", fee_idx).alias("leader"))
    zero = F.lit(0)
    return e.join(r, "slot", "full").select(
        "slot",
        F.coalesce("entry_count", zero).alias("entry_count"),
        F.coalesce("executed_tx", zero).alias("executed_tx"),
        F.coalesce("rewards", zero).alias("rewards"),
        "leader",
    )
