"""Explicit schemas as DDL, one per table. Unsigned 64-bit money columns are DECIMAL(20,0)."""

from __future__ import annotations

from pyspark.sql import types as T


ACCOUNTS = (
    "pubkey STRING, lamports DECIMAL(20,0), owner STRING, executable BOOLEAN, "
    "rent_epoch DECIMAL(20,0), data BINARY, write_version BIGINT, slot BIGINT, "
    "is_startup BOOLEAN, transaction_signature STRING"
)

INSTRUCTION = "STRUCT<program_id: STRING, accounts: ARRAY<STRING>, data: STRING>"

REWARD = (
    "STRUCT<pubkey: STRING, lamports: BIGINT, post_balance: DECIMAL(20,0), "
    "reward_type: STRING, commission: TINYINT>"
)

TRANSACTIONS = (
    "signature STRING, slot BIGINT, idx BIGINT, block_time BIGINT, is_vote BOOLEAN, err STRING, "
    "fee DECIMAL(20,0), recent_blockhash STRING, program_ids ARRAY<STRING>, "
    f"accounts ARRAY<STRING>, logs ARRAY<STRING>, instructions ARRAY<{INSTRUCTION}>, success BOOLEAN"
)

TOKEN_BALANCE = (
    "STRUCT<account_index: INT, mint: STRING, owner: STRING, amount: DECIMAL(20,0), "
    "decimals: TINYINT, ui_amount: DOUBLE>"
)

TRANSACTION_META = (
    "status BIGINT, fee DECIMAL(20,0), pre_balances ARRAY<DECIMAL(20,0)>, "
    "post_balances ARRAY<DECIMAL(20,0)>, "
    "inner_instructions ARRAY<STRUCT<index: INT, instructions: ARRAY<STRUCT<program_id_index: INT, "
    "accounts: BINARY, data: BINARY>>>>, "
    f"log_messages ARRAY<STRING>, pre_token_balances ARRAY<{TOKEN_BALANCE}>, "
    f"post_token_balances ARRAY<{TOKEN_BALANCE}>, rewards ARRAY<{REWARD}>"
)

BLOCKS = (
    "slot BIGINT, parent_slot BIGINT, status STRING, blockhash STRING, parent_blockhash STRING, "
    f"rewards ARRAY<{REWARD}>, block_time BIGINT, block_height BIGINT, transaction_count BIGINT, "
    "entry_count BIGINT, leader STRING"
)

ENTRIES = (
    "slot BIGINT, idx BIGINT, num_hashes BIGINT, hash BINARY, "
    "executed_transaction_count BIGINT, starting_transaction_index BIGINT"
)

SLOT_STATUS = "slot BIGINT, parent BIGINT, status STRING"

MENTIONS = "signature STRING, pubkey STRING, is_signer BOOLEAN, is_writable BOOLEAN"

DELEGATIONS = "seq BIGINT, operator STRING, staker STRING, amount DECIMAL(20,0), ts BIGINT"

VIOLATIONS = "operator STRING, ts TIMESTAMP, seq BIGINT, violation STRING"

VOTES = "block_hash STRING, validator STRING, seq BIGINT"

MESSAGES = (
    "message_id STRING, source STRING, topics ARRAY<STRING>, payload BINARY, ts TIMESTAMP"
)

HEALTH_CHECKS = "service STRING, check_name STRING, status STRING, details STRING"

WATCHLIST = "id STRING, type STRING, pubkey STRING, added TIMESTAMP, name STRING"

NAME_ACCOUNTS = (
    "name STRING, parent_name STRING, owner STRING, class STRING, expiry TIMESTAMP"
)

TABLES: dict[str, str] = {
    "accounts": ACCOUNTS,
    "transactions": TRANSACTIONS,
    "blocks": BLOCKS,
    "entries": ENTRIES,
    "slot_status": SLOT_STATUS,
    "transaction_mentions": MENTIONS,
    "delegations": DELEGATIONS,
    "violations": VIOLATIONS,
    "votes": VOTES,
    "messages": MESSAGES,
    "health_checks": HEALTH_CHECKS,
    "watchlist": WATCHLIST,
    "name_accounts": NAME_ACCOUNTS,
}


def schema(kind: str) -> T.StructType:
    """Schema object of a table (needs a running session to read the DDL)."""
    return T.StructType.fromDDL(TABLES[kind])
