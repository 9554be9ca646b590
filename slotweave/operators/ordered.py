"""Order-dependent jobs that stay parallel when one key holds a large part of all rows.

A window over a whole key would sort that key in one task. ``running`` splits every key into
contiguous ranges (``bucket``, any whole number that grows with the order): totals per range are
combined map-side, and the row-level window only spans one range. What a range starts from is
found by the same method over ranges of ranges, so no task sees more than ``FAN`` range totals, or
the totals of as many wide ranges as one key has.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave import session
from slotweave.session import cut_lineage, drop_folder, hand_over

FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
SEQ_WIDTH = 1_000_000  # rows per range when the order is an arrival number
FAN = 1000  # ranges of one wide range


def seq_bucket(column: str = "seq", width: int = SEQ_WIDTH) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


def _combine(how: str, a: Column, b: Column) -> Column:
    if how in ("sum", "count"):
        return F.coalesce(a + b, a, b)
    return F.greatest(a, b) if how == "max" else F.least(a, b)


def _range_starts(totals: DataFrame, keys: int, folds: dict[str, str]) -> DataFrame:
    """For every ``_range`` the folds over the earlier ranges of its key, as ``_start_`` columns."""
    key = [F.col(f"_range.k{i}").alias(f"k{i}") for i in range(keys)]
    wide = F.struct(*key, F.floor(F.col("_range.bucket") / FAN).alias("bucket"))
    ranges = totals.withColumn("_wide", wide)
    within = W.partitionBy("_wide").orderBy("_range.bucket").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*[F.col(f"_wide.k{i}") for i in range(keys)]).orderBy("_wide.bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = ranges.groupBy("_wide").agg(*[FOLDS[how](n).alias(n) for n, how in folds.items()])
    before = sums.select("_wide", *[FOLDS[how](n).over(across).alias(f"_before_{n}") for n, how in folds.items()])
    local = ranges.select("_wide", "_range", *[FOLDS[how](n).over(within).alias(n) for n, how in folds.items()])
    joined = local.join(before, "_wide", "left")
    return joined.select("_range", *[_combine(how, F.col(n), F.col(f"_before_{n}")).alias(f"_start_{n}") for n, how in folds.items()])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    folds: dict[str, tuple[str, Column]],
    before: bool = False,
) -> DataFrame:
    """Adds running folds per key: ``folds`` maps a new column to (sum/max/min/count, value).

    ``before=True`` leaves the current row out (NULL, or 0 for counts, on the first row).
    """
    # One struct names the range. It is the key of the row window and of the join alike, so the rows
    # are shuffled and sorted once; and structs with NULL fields still match each other.
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.withColumn("_range", F.struct(*parts, bucket.alias("bucket")))
    frame = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    totals = rows.groupBy("_range").agg(*[FOLDS[how](v).alias(n) for n, (how, v) in folds.items()])
    starts = _range_starts(totals, len(keys), {n: "sum" if how == "count" else how for n, (how, _) in folds.items()})
    local = rows.withColumns({n: FOLDS[how](v).over(frame) for n, (how, v) in folds.items()})
    joined = local.join(starts, "_range", "left")
    out = joined.withColumns({n: _combine(how, F.col(n), F.col(f"_start_{n}")) for n, (how, _) in folds.items()})
    return out.drop("_range", *[f"_start_{n}" for n in folds])


# --- running jobs -------------------------------------------------------------------------------


def advancing_slots(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Rows whose slot exceeds every earlier slot of the same source (of all rows for no keys)."""
    seen = running(df, keys, order, bucket, {"_seen": ("max", F.col("slot"))}, before=True)
    return seen.filter(F.col("_seen").isNull() | (F.col("slot") > F.col("_seen"))).drop("_seen")


def batch_ids(df: DataFrame, size: int, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Chunks of ``size`` rows in order, numbered from 0; size 0 puts all rows into one batch."""
    if size == 0:
        return df.withColumn("batch_id", F.lit(0).cast("bigint"))
    numbered = running(df, keys, order, bucket, {"_n": ("count", F.lit(1))})
    return numbered.withColumn("batch_id", F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


def delegation_ledger(ops: DataFrame, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Balances and removals of (operator, staker) pairs from ordered add/remove operations.

    A removal pays out everything added since the removal before it and zeroes the pair; without
    anything to pay out it is an error. Returns (open balances, removals).
    """
    pair = ["operator", "staker"]
    is_remove = F.col("op") == "remove"
    segments = running(
        ops, pair, ["seq"], seq_bucket() if bucket is None else bucket,
        {"_segment": ("count", F.when(is_remove, 1))}, before=True,
    ).withColumn("_segment", F.coalesce("_segment", F.lit(0)))
    parts = segments.groupBy(*pair, "_segment").agg(
        F.sum(F.when(~is_remove, F.col("amount"))).alias("amount"),
        F.count(F.when(~is_remove, 1)).alias("_adds"),
        F.max(F.when(is_remove, F.col("seq"))).alias("seq"),
    )
    balances = parts.filter(F.col("seq").isNull() & (F.col("_adds") > 0)).select(*pair, "amount")
    removals = parts.filter(F.col("seq").isNotNull()).select(
        "seq", *pair, F.when(F.col("_adds") > 0, F.col("amount")).alias("amount"),
        F.when(F.col("_adds") == 0, "delegation not found").alias("error"),
    )
    return balances, removals


# --- top rows per key ---------------------------------------------------------------------------


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salt: int = 1) -> DataFrame:
    """The first ``n`` rows of every key, with their rank as ``rn``.

    Up to an ``n`` of 1000 Spark cuts each key to ``n`` rows in every input task, before the shuffle.
    What is left of a hot key still grows with the number of input tasks; with ``salt`` > 1 it is
    first merged in ``salt`` groups of input tasks, so the last cut sees at most ``salt * n`` rows per
    key. Any assignment to groups gives the same result.
    """
    rows = df
    if salt > 1:
        part = W.partitionBy(*keys, "_part").orderBy(*order)
        rows = df.withColumn("_part", F.spark_partition_id() % salt).withColumn("_rn", F.row_number().over(part))
        rows = rows.filter(F.col("_rn") <= n).drop("_part", "_rn")
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def recent_per_key(df: DataFrame, keys: list[str], order: str = "seq", n: int = 1000, salt: int = 64) -> DataFrame:
    """The last ``n`` rows per key, newest first."""
    return top_per_key(df, keys, [F.col(order).desc()], n, salt)


# --- folds whose next step depends on what was accepted before ------------------------------------


def _chain(times, interval: float, start: float | None) -> list[float]:
    """Greedy chain over sorted distinct times: the next one at least ``interval`` after the last."""
    kept, i = [], 0
    if start is not None:
        i = times.searchsorted(start + interval)
    while i < len(times):
        kept.append(times[i])
        i = times.searchsorted(times[i] + interval)
    return kept


def distribution_gate(
    df: DataFrame, keys: list[str], time: str, seq: str, interval: int, block_seconds: int = 1_000_000
) -> DataFrame:
    """Keeps a tick only if it is at least ``interval`` seconds after the last *kept* tick.

    Of several ticks in one second only the first can be kept, so seconds are what is folded. Time
    is cut into blocks of about ``block_seconds`` (one interval at least), which bounds the ticks of a
    block. A block is a function from the last tick kept
    before it to the last one kept in it, and that function only has a few steps: greedy chains
    from different entry points soon meet. All blocks are reduced to their steps in parallel, the
    steps of a key are chained, and all blocks then emit their ticks in parallel.

    NULL keys form a group like any other. A tick without a time is never kept.
    """
    if interval <= 0:
        return df
    width = interval * max(1, block_seconds // interval)
    first = df.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.min(seq).alias("_seq")).withColumn("_block", F.floor(F.col(time) / width))
    key_fields = [first.schema[k] for k in keys]
    group = [*keys, "_block"]

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf[time].to_numpy())
        after = np.searchsorted(times, times + interval)
        end = np.where(after == len(times), np.arange(len(times)), after)
        while (end != end[end]).any():  # where the chain from each tick leaves the block
            end = end[end]
        entry_end = pdf["_block"].iloc[0] * width + interval
        stop = min(int(times.searchsorted(entry_end)), len(times) - 1)
        exits = times[end[: stop + 1]]  # of the ticks an earlier block can lead to
        step = np.append(exits[1:] != exits[:-1], True)
        out = pd.DataFrame({"_upto": times[: stop + 1][step], "_exit": exits[step]})
        for k in reversed(group):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    step_schema = T.StructType(
        [*key_fields, T.StructField("_block", T.LongType()), T.StructField("_upto", T.LongType()), T.StructField("_exit", T.LongType())]
    )
    step_rows = first.groupBy(*group).applyInPandas(steps, step_schema)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = None, []
        for block, part in pdf.sort_values(["_block", "_upto"]).groupby("_block", sort=True):
            rows.append((block, state))
            upto = part["_upto"].to_numpy()
            i = 0 if state is None else int(upto.searchsorted(state + interval))
            if i < len(upto):
                state = part["_exit"].iloc[i]
        out = pd.DataFrame({"_block": [r[0] for r in rows], "_state": pd.array([r[1] for r in rows], dtype="Int64")})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    link_schema = T.StructType([*key_fields, T.StructField("_block", T.LongType()), T.StructField("_state", T.LongType())])
    entry = step_rows.groupBy(*keys).applyInPandas(link, link_schema)

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        state = pdf["_state"].iloc[0]
        kept = _chain(pdf[time].to_numpy(), interval, None if pd.isna(state) else int(state))
        return pdf[pdf[time].isin(kept)][[*keys, time, "_seq"]]

    emit_schema = T.StructType([*key_fields, first.schema[time], first.schema["_seq"]])
    kept = _join_nulls(first, entry, group).groupBy(*group).applyInPandas(emit, emit_schema)
    kept = kept.withColumnRenamed("_seq", seq)
    return _join_nulls(df, kept, [*keys, time, seq], "left_semi")


def _join_nulls(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names whose NULLs match each other; they are returned once."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    joined = left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{c}" for c in on])


def stake_with_cap(
    events: DataFrame, minimum: int, cap: int = 1_000_000_000_000, order: list[str] = ["seq"], chunk: int = 1000,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds ``decision``: accepted / below minimum / over cap / invalid, deciding per operator in order.

    A request is over the cap when the operator's *accepted* total would pass it, and then does not
    count. ``order`` must be unique within an operator; ``bucket`` cuts it into ranges (default: by the first
    column, an arrival number). A NULL operator is an operator like any other; a NULL amount is invalid.

    An operator whose eligible requests fit under the cap needs no order at all: nothing of it is folded. Of the others
    one running sum accepts everything before the first request that does not fit. After that only
    requests that still fit can change anything, so each round takes the next ``chunk`` requests
    that fit the room left (a bounded group, found by a two-step top-n), folds them, and drops the
    requests that no longer fit. Room only shrinks, so what is left after a round is smaller than
    everything refused so far. Requests for nothing always fit and take no part, and those above the cap never fit. The events are
    stored once and read from there; of them only those from an operator's first refused request on meet the refused ones in a join. Rounds hand
    over through tables in the shared folder; all but those of the events and of the refused requests are deleted.
    """
    if chunk < 1:
        raise ValueError("chunk must be positive")
    if not 0 <= cap < 2**62:
        raise ValueError("cap must fit a signed 64-bit number with room for one more request")
    spark, amount, events = events.sparkSession, F.col("amount"), cut_lineage(events)
    wide = amount.cast("decimal(38,0)")
    sums = events.filter(amount >= minimum).groupBy("operator").agg(F.sum(wide).alias("_sum"), F.sum(F.greatest(wide, F.lit(0))).alias("_gross"))
    sums, summed_up = session.hand_over(sums)  # a row per operator
    crowded = sums.filter(F.col("_sum") > cap).select("operator")
    most = sums.agg(F.max("_gross")).first()[0] or 0
    money = "bigint" if most < 2**62 else "decimal(38,0)"  # no partial sum of an operator is larger
    cols = list(dict.fromkeys(["operator", *order, "amount"]))
    eligible = events.filter((amount >= minimum) & (amount <= cap) & (amount > 0)).withColumn("amount", amount.cast("bigint")).select(*cols)
    requests, stored = session.hand_over(_join_nulls(eligible, crowded, ["operator"], "left_semi"))
    ranges = seq_bucket(order[0]) if bucket is None else bucket
    position = F.struct(*order)
    summed = running(requests, ["operator"], order, ranges, {"_run": ("sum", amount.cast(money))})
    beyond, summing = session.hand_over(summed.filter(F.col("_run") > cap).select(*cols, "_run"))
    drop_folder(spark, stored)
    drop_folder(spark, summed_up)
    # amounts are positive, so what an operator's first refused request found is the least that one of them did
    found = F.min(F.col("_run") - amount)
    firsts = cut_lineage(beyond.groupBy("operator").agg((F.lit(cap) - found).cast("bigint").alias("_room"), F.min(position).alias("_first")))
    rest = _join_nulls(beyond, firsts.select("operator", "_room"), ["operator"])
    left, path = hand_over(rest.filter(amount <= F.col("_room")).select(*cols, "_room"))
    decided = T.StructType(
        [*left.select("operator", *order).schema.fields, T.StructField("_taken", T.BooleanType()), T.StructField("_next", T.LongType())]
    )

    def fold(requests: pa.Table) -> pa.Table:
        requests = requests.sort_by("rn")
        room, taken = requests.column("_room")[0].as_py(), []
        for amount in requests.column("amount").to_pylist():
            taken.append(amount <= room)
            room -= amount if taken[-1] else 0
        kept = requests.select(["operator", *order])
        return kept.append_column("_taken", pa.array(taken, pa.bool_())).append_column("_next", pa.array([room] * len(taken), pa.int64()))

    taken, folders = [], [summing]
    while not left.isEmpty():
        window = top_per_key(left, ["operator"], [F.col(c).asc() for c in order], chunk, salt=64)
        done, folder = session.hand_over(window.groupBy("operator").applyInArrow(fold, decided))
        taken.append(done.filter("_taken").select("operator", *order))
        folders.append(folder)
        state = done.groupBy("operator").agg(F.max(position).alias("_end"), F.min("_next").alias("_next"))
        rest = _join_nulls(left, state, ["operator"]).filter((position > F.col("_end")) & (amount <= F.col("_next")))
        before, (left, path) = path, hand_over(rest.select(*cols, F.col("_next").alias("_room")))
        drop_folder(spark, before)

    refused = beyond.select("operator", *order)
    if taken:
        refused = _join_nulls(refused, reduce(DataFrame.unionByName, taken), ["operator", *order], "left_anti")
    refused = cut_lineage(refused).withColumn("_refused", F.lit(True))
    for folder in [path, *folders]:
        drop_folder(spark, folder)
    placed = _join_nulls(events, firsts.select("operator", "_first"), ["operator"], "left")
    late = F.coalesce(position >= F.col("_first"), F.lit(False))
    marked = _join_nulls(placed.filter(late), refused, ["operator", *order], "left").unionByName(placed.filter(~late).withColumn("_refused", F.lit(None).cast("boolean")))
    decision = (
        F.when(amount.isNull(), "invalid")
        .when(amount < minimum, "below minimum")
        .when((amount > cap) | F.col("_refused").isNotNull(), "over cap")
        .otherwise("accepted")
    )
    return marked.withColumn("decision", decision).drop("_refused", "_first")
