"""Stake, rewards, commission, slashing and vote tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.scalars import base_penalty, reward_amount, severity, split_commission
from slotweave.operators.lookups import reward_multipliers, vote_stake
from slotweave.operators.ordered import running, top_per_key


def operator_stake(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("operator").agg(F.sum("amount").alias("total_stake"), F.count("*").alias("stakes"))


def delegations(events: DataFrame) -> DataFrame:
    """Total per (operator, staker). Filter by either column for the view of one of them."""
    return events.groupBy("operator", "staker").agg(F.sum("amount").alias("amount"))


def operator_delegations(events: DataFrame, operator: str) -> DataFrame:
    return delegations(events.filter(F.col("operator") == operator))


def staker_delegations(events: DataFrame, staker: str) -> DataFrame:
    return delegations(events.filter(F.col("staker") == staker))


def total_active_stake(operators: DataFrame) -> DataFrame:
    """One row: stake of the active set."""
    return operators.filter("is_active").agg(F.coalesce(F.sum("stake"), F.lit(0)).alias("total_stake"))


def supermajority(votes: DataFrame, operators: DataFrame, members_only: bool = False) -> DataFrame:
    """Vote stake per hash, confirmed when it is more than two thirds of the active stake."""
    total = total_active_stake(operators).scalar()
    return vote_stake(votes, operators, members_only).withColumn(
        "confirmed", F.col("vote_stake").cast("decimal(38,0)") * 3 > total.cast("decimal(38,0)") * 2
    )


def consensus_ready(operators: DataFrame, min_validators: int, threshold: float) -> DataFrame:
    """One row: distinct operators, and whether they are enough."""
    return operators.agg(F.countDistinct("operator").alias("operators")).withColumn(
        "ready",
        (F.col("operators") >= min_validators) & (F.col("operators") / F.lit(float(min_validators)) >= threshold),
    )


def top_peers(peers: DataFrame, n: int = 6) -> DataFrame:
    """Per topic the ``n`` peers with the most stake."""
    return top_per_key(peers, ["topic"], [F.col("stake").desc(), F.col("operator").asc()], n)


def slashing(violations: DataFrame, threshold: float, bucket: Column | None = None, order: list[str] = ["ts", "seq"]) -> DataFrame:
    """Running severity per operator, and the penalty of every violation at or past the threshold.

    ``bucket`` cuts time into the ranges that are summed in parallel (one second by default). An unknown violation has no severity.
    """
    by_second = F.unix_timestamp("ts").cast("bigint") if bucket is None else bucket
    known = F.coalesce(severity("violation"), F.lit(0))
    rows = running(violations, ["operator"], order, by_second, {"total_severity": ("sum", known)})
    over = F.col("total_severity") >= F.lit(str(threshold)).cast("decimal(20,4)")
    return rows.withColumns({"slashed": over, "penalty": F.when(over, base_penalty("violation")).otherwise(F.lit(0))})


def operator_rewards(scores: DataFrame, multipliers: DataFrame, base_rate: float = 0.10) -> DataFrame:
    return reward_multipliers(scores, multipliers).withColumn("reward", reward_amount("score", "multiplier", base_rate))


def epoch_rewards(scores: DataFrame, multipliers: DataFrame, base_rate: float = 0.10) -> DataFrame:
    """Total per epoch and operator.

    The rows come out of a join on ``operator``. Grouping by one struct keeps Spark from reusing that
    partitioning for the sums, which would leave a hot operator in one task: partial sums run
    inside the join tasks, AQE may split those, and only the partial sums are shuffled.
    """
    rewards = operator_rewards(scores, multipliers, base_rate)
    totals = rewards.groupBy(F.struct("epoch", "operator").alias("_key")).agg(F.sum("reward").alias("reward"))
    return totals.select("_key.*", "reward")


def distribute_rewards(current: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paid commission and net amount per operator, and what stays pending.

    A pending amount is paid together with a current one of the same operator. Every amount is
    split and truncated by itself before the sums.
    """
    due = pending.join(current.select("operator"), "operator", "left_semi")
    parts = current.select("operator", "amount").unionByName(due.select("operator", "amount"))
    split = parts.select("operator", "amount", split_commission("amount").alias("s"))
    paid = split.groupBy("operator").agg(
        F.sum("amount").alias("amount"), F.sum("s.commission").alias("commission"), F.sum("s.net").alias("net")
    )
    return paid, pending.join(current.select("operator"), "operator", "left_anti")
