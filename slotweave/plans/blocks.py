"""Blocks with their rewards and entries, from a table and from a feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave import fixtures as X
from slotweave.operators.assembly import assemble_blocks, block_entries
from slotweave.plans.feeds import events_feed
from slotweave.plans.oracle_views import oracle
from slotweave.plans.registry import query
from slotweave.plans.relational import BLOCK_STATE, BLOCKS_SQL
from slotweave.streaming import feeds, stateful

SIZE = 4  # slots of the test feed have 20 messages: some chunks are full, some are not
STATE = BLOCK_STATE.replace("v_slot_messages", "v_block_messages")
REWARDS_SQL = BLOCKS_SQL.replace("v_slot_messages", "v_block_messages").replace("AS executed_tx", "AS executed_tx, coalesce(array_to_string(m.rewards, '|'), '') AS rewards")
ENTRIES_SQL = f"""
    SELECT slot, max(seq) AS seq, (n - 1) // {SIZE} AS chunk, string_agg(entry, '|' ORDER BY seq) AS entries
    FROM ent GROUP BY slot, (n - 1) // {SIZE} HAVING count(*) = {SIZE}
    UNION ALL
    SELECT p.slot, p.seq, p.entries // {SIZE} AS chunk, string_agg(e.entry, '|' ORDER BY e.seq) AS entries
    FROM st p JOIN ent e ON e.slot = p.slot AND e.n > p.entries // {SIZE} * {SIZE} AND e.n <= p.entries
    WHERE p.kind <> 'entry' AND p.now_status = 'rooted' AND p.entries % {SIZE} > 0 GROUP BY p.slot, p.seq, p.entries"""
ENT = "SELECT slot, seq, entry, row_number() OVER (PARTITION BY slot ORDER BY seq) AS n FROM v_block_messages WHERE kind = 'entry'"


def _texts(df, column: str, fields: list[str]):
    """The list as one text, to compare it as it is."""
    part = lambda x, f: F.coalesce(x[f].cast("string"), F.lit(""))
    one = lambda x: F.concat_ws(":", *[part(x, f) for f in fields])
    return df.withColumn(column, F.array_join(F.transform(column, one), "|"))


def reward_texts(blocks):
    return _texts(blocks, "rewards", ["pubkey", "lamports", "post_balance", "reward_type", "commission"])


def entry_texts(entries):
    return _texts(entries, "entries", ["entry_index", "num_hashes", "hash", "executed_tx", "starting_transaction_index"])


@query("t1_block_rewards", oracle("v_block_messages", REWARDS_SQL, st=STATE))
def rewards(v):
    return reward_texts(assemble_blocks(v.block_messages))


@query("t1_block_entries", oracle("v_block_messages", ENTRIES_SQL, st=STATE, ent=ENT))
def entries(v):
    return entry_texts(block_entries(v.block_messages, SIZE))


@query("t1_block_rewards_stream", oracle("v_block_messages", REWARDS_SQL, st=STATE))
def rewards_stream(v):
    return reward_texts(feeds.drain(stateful.assemble_blocks_stream(X.block_messages(events_feed(v))), "blocks"))


@query("t1_block_entries_stream", oracle("v_block_messages", ENTRIES_SQL, st=STATE, ent=ENT))
def entries_stream(v):
    return entry_texts(feeds.drain(stateful.block_entries_stream(X.block_messages(events_feed(v)), SIZE), "entries"))
