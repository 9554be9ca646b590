"""Blocks put together from status, metadata and entry messages of their slot.

A block is one row with its rewards; its entries are rows of up to ``CHUNK`` of them, so that no row grows with its slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.operators.ordered import running, seq_bucket

METADATA = ["blockhash", "block_time", "block_height", "transaction_count", "entry_count"]
BLOCK_COLUMNS = [
    "slot", "seq", "parent_slot", "status", "blockhash", "block_time", "block_height",
    "transaction_count", "entry_count", "executed_tx",
]
ENTRY = ["entry_index", "num_hashes", "hash", "executed_tx", "starting_transaction_index"]
CHUNK = 1000  # entries of one row


def assemble_blocks(messages: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Every block a slot publishes: on each ``rooted`` status, and on metadata after one.

    A row is the state of the slot at that message (``seq``). Metadata overwrites metadata. The
    entry count is the one the last metadata carries, else the entries so far. The parent slot is the last
    one metadata carries, else the parent of the status that opened the slot. Messages with a column ``rewards`` give
    blocks the rewards of the last metadata, an empty list before any. ``block_entries`` has the entries.
    """
    is_meta, is_status, is_entry = _kinds()
    folds = {
        "_meta": ("max", F.when(is_meta, F.struct("seq", *METADATA))),
        "_status": ("max", F.when(is_status, F.struct("seq", "status"))),
        "_parent": ("max", F.when(is_meta & F.col("parent_slot").isNotNull(), F.struct("seq", "parent_slot"))),
        "_first": ("min", F.struct("seq", F.when(is_status, F.col("parent")).alias("parent"))),
        "_entries": ("count", F.when(is_entry, 1)),
        "_executed": ("sum", F.when(is_entry, F.col("executed_tx"))),
    }
    state = running(messages, ["slot"], ["seq"], seq_bucket() if bucket is None else bucket, folds)
    published = state.filter((is_status | is_meta) & (F.col("_status.status") == "rooted"))
    blocks = published.select(
        "slot",
        "seq",
        F.coalesce("_parent.parent_slot", "_first.parent").alias("parent_slot"),
        F.lit("rooted").alias("status"),
        *[F.col(f"_meta.{c}").alias(c) for c in METADATA[:-1]],
        F.coalesce("_meta.entry_count", "_entries").cast("bigint").alias("entry_count"),
        F.coalesce("_executed", F.lit(0)).cast("bigint").alias("executed_tx"),
        *([F.col("_meta.seq").alias("_from")] if "rewards" in messages.columns else []),
    )
    return _with_rewards(blocks, messages.filter(is_meta)) if "rewards" in messages.columns else blocks


def _kinds() -> tuple[Column, Column, Column]:
    return tuple(F.col("kind") == k for k in ("metadata", "status", "entry"))


def _with_rewards(blocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rewards are read from the metadata a block names in ``_from``: the folds carry its number, not the list."""
    rewards = metadata.select(F.col("slot").alias("_slot"), F.col("seq").alias("_seq"), "rewards")
    joined = blocks.join(rewards, F.col("slot").eqNullSafe(F.col("_slot")) & (F.col("_from") == F.col("_seq")), "left")
    none = F.array().cast(metadata.schema["rewards"].dataType)
    return joined.select(*blocks.drop("_from").columns, F.coalesce("rewards", none).alias("rewards"))


def block_entries(messages: DataFrame, size: int = CHUNK, bucket: Column | None = None) -> DataFrame:
    """Entries of published blocks, as rows slot, seq, chunk and entries (in order of arrival).

    Chunk k of a slot holds its entries k * size + 1 up to (k + 1) * size. It is given when it is full, under its last entry's seq, and as far as it is
    filled whenever the block is published, under that message's seq. So the entries of the block published at ``seq`` are
    those of the full chunks up to there and of the one with that very seq.
    """
    is_meta, is_status, is_entry = _kinds()
    fields = [c for c in ENTRY if c in messages.columns]
    folds = {"_n": ("count", F.when(is_entry, 1)), "_status": ("max", F.when(is_status, F.struct("seq", "status")))}
    state = running(messages.select("slot", "seq", "kind", "status", *fields), ["slot"], ["seq"], seq_bucket() if bucket is None else bucket, folds)
    own = state.filter(is_entry).withColumn("chunk", F.floor((F.col("_n") - 1) / size))
    chunks = own.groupBy(F.struct("slot", "chunk").alias("k")).agg(F.sort_array(F.collect_list(F.struct("seq", *fields))).alias("all"))  # size rows at most
    chunks = chunks.select("k.slot", "k.chunk", "all")
    whole = chunks.filter(F.size("all") == size).select("slot", F.element_at("all", -1)["seq"].alias("seq"), "chunk", "all")
    open_ = state.filter((is_status | is_meta) & (F.col("_status.status") == "rooted") & (F.col("_n") % size > 0))
    open_ = open_.select(F.col("slot").alias("_slot"), "seq", F.floor(F.col("_n") / size).alias("_chunk"), (F.col("_n") % size).cast("int").alias("_size"))
    part = open_.join(chunks, F.col("slot").eqNullSafe(F.col("_slot")) & (F.col("chunk") == F.col("_chunk")))
    part = part.select("slot", "seq", "chunk", F.slice("all", F.lit(1), F.col("_size")).alias("all"))
    bare = F.transform("all", lambda e: F.struct(*[e[c].alias(c) for c in fields]))
    return whole.unionByName(part).select("slot", "seq", "chunk", bare.alias("entries"))


def evict_rooted(blocks: DataFrame, keep_slots: int = 1000) -> DataFrame:
    """Drops rooted slots more than ``keep_slots`` behind the newest slot."""
    newest = blocks.agg(F.max("slot")).scalar()
    old = (F.col("status") == "rooted") & (F.col("slot") < newest - keep_slots)
    return blocks.filter(~F.coalesce(old, F.lit(False)))
