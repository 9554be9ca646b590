"""Lookups written as joins; Catalyst and AQE pick broadcast or shuffle and split skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions.scalars import account_role_flags, key_data, message_priority
from slotweave.operators.latest import earliest_by


# --- by program and by account --------------------------------------------------------------------


def _newest(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def transactions_by_program(df: DataFrame, program: str, limit: int = 10, order: list[str] = ["slot", "idx"]) -> DataFrame:
    """Newest transactions of a program, each once. A scan with a top-k; nothing is shuffled by key."""
    return _newest(df.filter(F.array_contains("program_ids", program)), order, limit)


def transactions_by_account(df: DataFrame, account: str, limit: int = 10, order: list[str] = ["slot", "idx"]) -> DataFrame:
    return _newest(df.filter(F.array_contains("accounts", account)), order, limit)


def build_index(df: DataFrame, array: str, key: str, keep: list[str]) -> DataFrame:
    """One row per (key, transaction) from an array column, each pair once."""
    return df.select(F.explode(F.array_distinct(array)).alias(key), *keep)


def build_mentions(tx: DataFrame, roles: str | None = None) -> DataFrame:
    """Bridge rows (signature, pubkey, is_signer, is_writable), one per pair.

    ``roles`` names an array of role codes parallel to ``accounts``. Without it the first account
    is the signing fee payer, and all are writable. A key that occurs twice has the union of its flags.
    Signatures are unique, so pairs are made unique inside the row and nothing is shuffled.
    """
    role = (
        F.transform("accounts", lambda a, i: F.when(i == 0, 3).otherwise(1)) if roles is None else F.col(roles)
    )
    pairs = F.zip_with("accounts", role, lambda a, r: F.struct(a.alias("pubkey"), account_role_flags(r).alias("flags")))
    merged = F.transform(
        F.array_distinct("accounts"),
        lambda a: F.struct(
            a.alias("pubkey"),
            F.exists("_pairs", lambda p: (p["pubkey"] == a) & p["flags"]["is_signer"]).alias("is_signer"),
            F.exists("_pairs", lambda p: (p["pubkey"] == a) & p["flags"]["is_writable"]).alias("is_writable"),
        ),
    )
    return tx.withColumn("_pairs", pairs).select("signature", F.inline(merged))


def cascade_mentions(mentions: DataFrame, tx: DataFrame) -> DataFrame:
    """Mentions whose transaction still exists."""
    return mentions.join(tx.select("signature"), "signature", "left_semi")


def orphan_mentions(mentions: DataFrame, tx: DataFrame) -> DataFrame:
    return mentions.join(tx.select("signature"), "signature", "left_anti")


# --- watchlist --------------------------------------------------------------------------------------


def enrich_watchlist(watch: DataFrame, accounts: DataFrame, tx: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each watched entity with its data; a miss stays as a row with ``error`` set.

    ``accounts`` holds one row per key, ``tokens`` one row per (owner, mint); only watched owners are counted.
    """
    owners = watch.filter(F.col("type") == "token").select(F.col("pubkey").alias("owner")).distinct()
    counts = tokens.join(owners, "owner", "left_semi").groupBy(F.col("owner").alias("pubkey")).agg(F.count("*").alias("tokens"))
    none = F.lit(None).cast("bigint")
    acc = (
        watch.filter(F.col("type") == "account")
        .join(accounts.select("pubkey", F.col("lamports").cast("bigint").alias("lamports")), "pubkey", "left")
        .select(*watch.columns, "lamports", none.alias("slot"), none.alias("tokens"))
    )
    txs = (
        watch.filter(F.col("type") == "transaction")
        .join(tx.select(F.col("signature").alias("pubkey"), "slot"), "pubkey", "left")
        .select(*watch.columns, none.alias("lamports"), "slot", none.alias("tokens"))
    )
    tok = (
        watch.filter(F.col("type") == "token")
        .join(counts, "pubkey", "left")
        .select(*watch.columns, none.alias("lamports"), none.alias("slot"), "tokens")
    )
    miss = F.coalesce("lamports", "slot", "tokens").isNull()
    rows = acc.unionByName(txs).unionByName(tok)
    return rows.withColumns({"error": miss, "key_data": key_data("type", "lamports", "slot", "tokens")})


# --- operators, votes, messages -----------------------------------------------------------------------


def with_operator_stake(df: DataFrame, operators: DataFrame, column: str = "operator") -> DataFrame:
    """Adds ``stake``; a source that is no operator has 0."""
    stakes = operators.select(F.col("operator").alias("_operator"), F.col("stake").alias("_stake"))
    joined = df.join(stakes, F.col(column) == F.col("_operator"), "left")
    return joined.withColumn("stake", F.coalesce("_stake", F.lit(0))).drop("_operator", "_stake")


def vote_stake(votes: DataFrame, operators: DataFrame, members_only: bool = False) -> DataFrame:
    """Stake behind every block hash; a validator counts once per hash."""
    distinct = votes.select("block_hash", "validator").distinct()
    if members_only:
        distinct = distinct.join(
            operators.filter("is_active").select(F.col("operator").alias("validator")), "validator", "left_semi"
        )
    staked = with_operator_stake(distinct, operators, "validator")
    return staked.groupBy("block_hash").agg(
        F.sum("stake").alias("vote_stake"), F.count("*").alias("voters")
    )


def admit_messages(messages: DataFrame, operators: DataFrame, minimum: int) -> DataFrame:
    """Messages of sufficiently staked sources, the first of every id, with a priority."""
    staked = with_operator_stake(messages, operators, "source").filter(F.col("stake") >= minimum)
    first = earliest_by(staked, ["message_id"], F.struct("seq"))
    return first.withColumn("priority", message_priority("stake"))


def dedup_messages(messages: DataFrame) -> DataFrame:
    """The first arrival of every message id."""
    return earliest_by(messages, ["message_id"], F.struct("seq"))


def fan_out_topics(messages: DataFrame, subscriptions: list[str] | None = None) -> DataFrame:
    """A copy of a message for each of its topics, limited to the subscribed ones when given."""
    out = messages.select(*[c for c in messages.columns if c != "topics"], F.explode("topics").alias("topic"))
    return out if subscriptions is None else out.filter(F.col("topic").isin(subscriptions))


def reward_multipliers(scores: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Adds the operator's latest multiplier, 1.0 without one."""
    last = multipliers.groupBy("operator").agg(F.max_by("multiplier", "seq").alias("multiplier"))
    return scores.join(last, "operator", "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


# --- chains of blocks -----------------------------------------------------------------------------------


def chain_link_check(blocks: DataFrame) -> DataFrame:
    """Per block: is the parent stored, does its hash match, is the height one more than its height?"""
    parent = blocks.select(
        F.col("slot").alias("parent_slot"), F.col("blockhash").alias("_hash"), F.col("block_height").alias("_height"),
        F.lit(True).alias("_found"),
    )
    return blocks.join(parent, "parent_slot", "left").select(
        "slot",
        "parent_slot",
        F.col("_found").isNotNull().alias("parent_found"),
        F.coalesce(F.col("_hash") == F.col("parent_blockhash"), F.lit(False)).alias("hash_ok"),
        F.coalesce(F.col("block_height") == F.col("_height") + 1, F.lit(False)).alias("height_ok"),
    )


def contiguous_blocks(blocks: DataFrame, limit: int, show_gaps: bool = False) -> DataFrame:
    """Blocks of the newest ``limit`` slots; slots without a block are skipped or shown empty."""
    newest = blocks.agg(F.max("slot").alias("top"))
    recent = blocks.filter(F.col("slot") > newest.scalar() - limit)
    if not show_gaps:
        return recent
    slots = newest.select(F.explode(F.sequence(F.greatest(F.col("top") - limit + 1, F.lit(0)), F.col("top"))).alias("slot"))
    return slots.join(recent, "slot", "left")
