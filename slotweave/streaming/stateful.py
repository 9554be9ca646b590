"""Keyed state jobs: what a key has seen so far decides about its next row.

State per key is a few numbers, and for a slot the rewards of one block and the entries of one chunk. Rows of a key are ordered inside a
micro-batch, whose size the source's rate options bound; the order between micro-batches is the feed's. Folds of keys
that may be hot are in ``streaming.folds``, which never brings a key's rows together.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slotweave.functions.scalars import DEFAULT_PENALTY, PENALTY, SEVERITY
from slotweave.operators.assembly import BLOCK_COLUMNS, CHUNK, ENTRY, METADATA
from slotweave.schemas import REWARD

# The worker that sets up a stateful query on the driver's side does not see files added to the application.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema, time_mode: str = "None") -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", time_mode)


def _ordered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, ignore_index=True)


def _exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole numbers as decimals: pandas would hold those of a column with NULLs as floats, which a state doesn't take and which lose digits."""
    whole = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    return df.withColumns({c: F.col(c).cast("decimal(20,0)") for c in whole}) if whole else df


class _Advance(StatefulProcessor):
    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", T.StructType([T.StructField("slot", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows, self.order)
        seen = self.top.get()[0] if self.top.exists() else None
        before = pdf["slot"].cummax().shift(1)
        if seen is not None:
            before = before.fillna(seen).clip(lower=seen)
        self.top.update((int(pdf["slot"].max() if seen is None else max(seen, pdf["slot"].max())),))
        yield pdf[before.isna() | (pdf["slot"] > before)]

    def close(self) -> None:
        pass


def advancing_slots_stream(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose slot exceeds every earlier slot of the same source."""
    return _with_state(df, [key], _Advance(order), df.schema)


# --- many keys a call --------------------------------------------------------------------------------
#
# A call of a processor costs milliseconds, whatever it is given, and every access to its state costs another round trip. So where keys are many, a call
# gets a bucket of keys with all their rows of the micro-batch, folds them together, and the state of a bucket is one value: its keys' states, pickled.

#: Buckets by a key's hash. A micro-batch has that many calls at most, however many keys there are.
BUCKETS = 256
#: Slots are dealt in turn to this many buckets of each range of slots, and a bucket has as many slots: messages that come together are dealt
#: to many tasks, and the states of slots long past are not read again.
LANES = 64
NULLS = "slotweave_nulls"  # bits of the whole numbers that are NULL; names that begin with _ don't reach a processor
BUCKET, RANGE, LANE = "slotweave_bucket", "slotweave_range", "slotweave_lane"
PACKED = T.StructType([T.StructField("packed", T.BinaryType())])


def _hash_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _whole(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.IntegralType)]


def _fill(df: DataFrame) -> DataFrame:
    """Whole numbers without NULLs and ``NULLS``: pandas would hold a column with NULLs as floats, which lose digits. ``_unfill`` is the way back."""
    whole = _whole(df.schema)
    bits = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(whole)), F.lit(0).cast("bigint"))
    return df.withColumns({**{c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in whole}, NULLS: bits})


def _unfill(df: DataFrame, schema: T.StructType) -> DataFrame:
    whole = _whole(schema)
    return df.withColumns({c: F.when(F.col(NULLS).bitwiseAND(F.lit(1 << i)) == 0, F.col(c)) for i, c in enumerate(whole)}).drop(NULLS)


def _missing(pdf: pd.DataFrame, column: str, whole: list[str]) -> np.ndarray:
    """Where ``column`` of filled rows is NULL."""
    return (pdf[NULLS].to_numpy() >> whole.index(column) & 1).astype(bool) if column in whole else pdf[column].isna().to_numpy()


def _objects(pdf: pd.DataFrame, column: str, whole: list[str]) -> np.ndarray:
    values = pdf[column].to_numpy().astype(object)
    values[_missing(pdf, column, whole)] = None
    return values


def _by_key(rows: Iterator[pd.DataFrame], key: str, order: list[str], whole: list[str]) -> tuple[pd.DataFrame, list, np.ndarray, np.ndarray]:
    """Filled rows by key and in order, NULLs last; the keys, the number of each row's key, and the first row of each."""
    pdf = pd.concat(list(rows), ignore_index=True)
    codes, _ = pd.factorize(_objects(pdf, key, whole), use_na_sentinel=False)
    ranks = [codes]
    for c in order:
        rank = pd.factorize(pdf[c], sort=True)[0]
        ranks.append(np.where(_missing(pdf, c, whole), len(pdf), rank))
    place = np.lexsort(ranks[::-1])
    pdf, codes = pdf.take(place).reset_index(drop=True), codes[place]
    begins = np.append(True, codes[1:] != codes[:-1])
    first = np.flatnonzero(begins)
    return pdf, _objects(pdf, key, whole)[first].tolist(), np.cumsum(begins) - 1, first


def _sums(values: np.ndarray, codes: np.ndarray, first: np.ndarray, before: list[int]) -> np.ndarray:
    """Running sums of every key, which go on from ``before``."""
    total = np.cumsum(values)
    return total + (np.array(before, np.int64) - (total - values)[first])[codes]


def _latest(where: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the place of its key's latest row so far that ``where`` marks; past the end, by the key's number, if there is none."""
    place = np.maximum.accumulate(np.where(where, np.arange(len(where)), -1))
    return np.where(place >= first[codes], place, len(where) + codes)


def _followed(values: np.ndarray, before: list) -> np.ndarray:
    out = np.empty(len(values) + len(before), object)
    out[: len(values)] = values
    for i, value in enumerate(before, len(values)):
        out[i] = value
    return out


class _Packed(StatefulProcessor):
    """Holds the states of a bucket's keys, by key, as one value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packed = handle.getValueState("packed", PACKED)

    def load(self) -> dict:
        return pickle.loads(bytes(self.packed.get()[0])) if self.packed.exists() else {}

    def store(self, states: dict) -> None:
        self.packed.update((pickle.dumps(states, pickle.HIGHEST_PROTOCOL),)) if states else self.packed.clear()

    def close(self) -> None:
        pass


class _Slash(_Packed):
    """Holds the tenths of severity so far of each operator."""

    def __init__(self, threshold_tenths: float, order: list[str], columns: list[str], whole: list[str]):
        self.threshold, self.order, self.columns, self.whole = threshold_tenths, order, columns, whole

    def handleInputRows(self, key, rows, timerValues):
        pdf, names, codes, first = _by_key(rows, "operator", self.order, self.whole)
        totals = self.load()
        tenths = pdf["violation"].map({k: int(float(v) * 10) for k, v in SEVERITY.items()}).fillna(0).astype("int64").to_numpy()
        running = _sums(tenths, codes, first, [totals.get(n, 0) for n in names])
        totals.update(zip(names, running[np.append(first[1:], len(pdf)) - 1].tolist()))
        self.store(totals)
        over = running >= self.threshold
        pdf["severity_tenths"] = running
        pdf["slashed"] = over
        pdf["penalty"] = pdf["violation"].map(PENALTY).fillna(DEFAULT_PENALTY).astype("int64").where(over, 0)
        yield pdf[self.columns]


def slashing_stream(violations: DataFrame, threshold: float, order: list[str] = ["ts", "seq"]) -> DataFrame:
    """Violations with the running severity of their operator and the penalty due.

    Severity is kept in tenths, so sums are exact.
    """
    filled = _fill(violations)
    schema = T.StructType(
        [
            *filled.schema.fields,
            T.StructField("severity_tenths", T.LongType()),
            T.StructField("slashed", T.BooleanType()),
            T.StructField("penalty", T.LongType()),
        ]
    )
    processor = _Slash(round(threshold * 10, 6), order, schema.names, _whole(violations.schema))
    rows = _unfill(_with_state(filled.withColumn(BUCKET, _hash_bucket("operator")), [BUCKET], processor, schema), violations.schema)
    return rows.withColumn("total_severity", (F.col("severity_tenths").cast("decimal(20,0)") / 10).cast("decimal(20,1)")).drop(
        "severity_tenths"
    )


SLOT_STATE = ["status", "parent_slot", "blockhash", *METADATA[1:], "entries", "executed_tx", "rewards", "due"]


def _replace(state, rows: list[tuple]) -> None:
    """What a list state holds; it takes no empty list."""
    state.put(rows) if rows else state.clear()


class _Assemble(_Packed):
    """Holds the open state of each slot: the last metadata with its rewards, the status, two counters, and when it is to be dropped."""

    def __init__(self, whole: list[str], evict: bool, rewards: bool = False, sweep: int | None = None):
        self.whole, self.evict, self.rewards, self.sweep = whole, evict, rewards, sweep

    def handleInputRows(self, key, rows, timerValues):
        pdf, slots, codes, first = _by_key(rows, "slot", ["seq"], self.whole)
        states, last = self.load(), np.append(first[1:], len(pdf)) - 1
        known = [dict(zip(SLOT_STATE, states[n])) if n in states else None for n in slots]
        before = [k or dict.fromkeys(SLOT_STATE) for k in known]
        meta, status, entry = (pdf["kind"].eq(k).to_numpy() for k in ("metadata", "status", "entry"))
        column = {c: _objects(pdf, c, self.whole) for c in ("parent_slot", "status", *METADATA)}
        for i in (i for i, k in enumerate(known) if k is None and status[first[i]]):
            before[i]["parent_slot"] = None if _missing(pdf.iloc[first[i] : first[i] + 1], "parent", self.whole)[0] else int(pdf["parent"].iloc[first[i]])
        ones = entry.astype(np.int64)
        executed = np.where(entry & ~_missing(pdf, "executed_tx", self.whole), pdf["executed_tx"].to_numpy(), 0).astype(np.int64)
        sums = {"entries": _sums(ones, codes, first, [s["entries"] or 0 for s in before]), "executed_tx": _sums(executed, codes, first, [s["executed_tx"] or 0 for s in before])}
        # what the last metadata, parent and status said: the place of that message, or the state so far
        said = _latest(meta, codes, first)
        places = {**dict.fromkeys(METADATA, said), "status": _latest(status, codes, first)}
        places["parent_slot"] = _latest(meta & ~_missing(pdf, "parent_slot", self.whole), codes, first)
        if self.rewards:
            paid = np.empty(len(pdf), object)
            for i in np.flatnonzero(meta).tolist():
                paid[i] = _records(pdf["rewards"].iat[i])
            column["rewards"], places["rewards"] = paid, said
        values = {c: _followed(column[c], [s[c] for s in before]) for c in places}
        now = lambda c, at: sums[c][at] if c in sums else values[c][places[c][at]]
        after = {c: now(c, last).tolist() for c in SLOT_STATE if c in sums or c in places}
        due = [s["due"] for s in before]
        rooted = [i for i, x in enumerate(after["status"]) if x == "rooted" and not (self.evict and slots[i] is None)]
        if rooted and self.evict:
            for i in rooted:
                due[i] = (slots[i] + 1) * 1000
            self.handle.registerTimer(max(due[i] for i in rooted))
        elif rooted and self.sweep is not None:
            at = timerValues.getCurrentProcessingTimeInMs() + self.sweep
            for i in rooted:
                due[i] = at
            self.handle.registerTimer(at)
        states.update(zip(slots, zip(*[due if c == "due" else after.get(c, [None] * len(slots)) for c in SLOT_STATE])))
        self.store(states)
        shown = np.flatnonzero(~entry & (values["status"][places["status"]] == "rooted"))
        made = {c: now(c, shown) for c in [*METADATA, "parent_slot", "status", "entries", "executed_tx"]}
        out = pd.DataFrame({"slot": _objects(pdf, "slot", self.whole)[shown], "seq": _objects(pdf, "seq", self.whole)[shown], **made})
        out["entry_count"] = np.where([x is None for x in made["entry_count"]], made["entries"], made["entry_count"])
        if self.rewards:
            out["rewards"] = pd.Series([r or [] for r in now("rewards", shown)], dtype=object)
        yield out[[*BLOCK_COLUMNS, *(["rewards"] if self.rewards else [])]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, due = expiredTimerInfo.getExpiryTimeInMs(), SLOT_STATE.index("due")
        self.store({n: s for n, s in self.load().items() if s[due] is None or s[due] > at})
        return iter([])


REWARD_STATE = T.StructType(
    [T.StructField("pubkey", T.StringType()), T.StructField("lamports", T.LongType()), T.StructField("post_balance", T.DecimalType(20, 0)),
     T.StructField("reward_type", T.StringType()), T.StructField("commission", T.ByteType())]
)


def _records(rewards) -> list[tuple] | None:
    """A list of rewards as tuples, in the order of their fields, however it came over."""
    if rewards is None or (isinstance(rewards, float) and np.isnan(rewards)):
        return None
    return [tuple(r.get(f) for f in REWARD_STATE.names) if isinstance(r, dict) else tuple(r) for r in rewards]


class _Chunks(_Packed):
    """Holds the status of each slot, how many entries it has had, and those of its open chunk."""

    def __init__(self, size: int, fields: list[str], whole: list[str]):
        self.size, self.fields, self.whole = size, fields, whole

    def handleInputRows(self, key, rows, timerValues):
        pdf, slots, codes, first = _by_key(rows, "slot", ["seq"], self.whole)
        states, last = self.load(), np.append(first[1:], len(pdf)) - 1
        known = [states.get(n, (None, 0, [])) for n in slots]
        kind = pdf["kind"]
        entry = kind.eq("entry").to_numpy()
        status = _followed(_objects(pdf, "status", self.whole), [k[0] for k in known])[_latest(kind.eq("status").to_numpy(), codes, first)]
        count = _sums(entry.astype(np.int64), codes, first, [k[1] for k in known])
        new = list(zip(*[_objects(pdf, c, self.whole)[entry] for c in self.fields]))
        ends = np.cumsum(entry)[last].tolist()
        held = [k[2] + new[lo:hi] for k, lo, hi in zip(known, [0, *ends], ends)]
        start = [k[1] - len(k[2]) for k in known]  # entries in full chunks
        filled = entry & (count % self.size == 0)
        shown = ~entry & (status == "rooted") & (count % self.size > 0)
        at = np.flatnonzero(filled | shown)
        out = []
        for k, seq, n in zip(codes[at].tolist(), _objects(pdf, "seq", self.whole)[at], count[at].tolist()):
            chunk = (n - 1) // self.size
            out.append((slots[k], seq, chunk, held[k][chunk * self.size - start[k] : n - start[k]]))
        for k, (n, total) in enumerate(zip(slots, count[last].tolist())):
            states[n] = (status[last[k]], total, held[k][total // self.size * self.size - start[k] :])
        self.store(states)
        yield pd.DataFrame(out, columns=["slot", "seq", "chunk", "entries"])


def block_entries_stream(messages: DataFrame, size: int = CHUNK) -> DataFrame:
    """Streaming form of ``operators.assembly.block_entries``: the same rows. A slot's state holds fewer than ``size`` entries."""
    fields = [c for c in ENTRY if c in messages.columns]
    own = messages.select("slot", "seq", "kind", "status", *fields)
    entries = T.ArrayType(T.StructType([messages.schema[c] for c in fields]))
    schema = T.StructType([messages.schema["slot"], messages.schema["seq"], T.StructField("chunk", T.LongType()), T.StructField("entries", entries)])
    return _with_slots(own, _Chunks(size, fields, _whole(own.schema)), schema)


def _with_slots(messages: DataFrame, processor: StatefulProcessor, schema, time_mode: str = "None") -> DataFrame:
    dealt = _fill(messages).withColumns({RANGE: F.floor(F.col("slot") / (LANES * LANES)), LANE: F.pmod("slot", F.lit(LANES))})
    return _with_state(dealt, [RANGE, LANE], processor, schema, time_mode)


BLOCK_SCHEMA = (
    "slot BIGINT, seq BIGINT, parent_slot BIGINT, status STRING, blockhash STRING, block_time BIGINT, "
    "block_height BIGINT, transaction_count BIGINT, entry_count BIGINT, executed_tx BIGINT"
)


def assemble_blocks_stream(messages: DataFrame, keep_slots: int | None = None, sweep: str | None = None) -> DataFrame:
    """Streaming form of ``operators.assembly.assemble_blocks``, with ``rewards`` if messages have them.

    With ``keep_slots`` the slot number acts as event time: the state of a rooted slot is dropped
    once the newest slot is that many slots ahead. Messages later than that are ignored; the query's progress counts them
    (``monitor.late_rows``).

    With ``sweep`` (like ``"60 seconds"``) the state of a rooted slot is dropped when that much time has gone by on the clock
    since its last message, be there new input or not; a later message opens the slot anew.
    """
    if keep_slots is not None and sweep is not None:
        raise ValueError("state is dropped by slots or by the clock, not by both")
    rewards = "rewards" in messages.columns
    schema = BLOCK_SCHEMA + (f", rewards ARRAY<{REWARD}>" if rewards else "")
    whole = _whole(messages.schema)
    if keep_slots is None:
        pause = None if sweep is None else int(pd.Timedelta(sweep).total_seconds() * 1000)
        return _with_slots(messages, _Assemble(whole, False, rewards, pause), schema, "None" if sweep is None else "ProcessingTime")
    # One second per slot. Times start at 1 because the first watermark is 0; a time equal to the
    # watermark is late, so the extra second keeps the slot exactly ``keep_slots`` behind.
    timed = messages.withColumn("slot_time", F.timestamp_seconds(F.col("slot") + 1))
    timed = timed.withWatermark("slot_time", f"{keep_slots + 1} seconds")
    return _with_slots(timed, _Assemble(whole, True, rewards), schema, "EventTime")


# --- batches that close by count or by time ---------------------------------------------------------


class _Batches(StatefulProcessor):
    """Holds the rows of a lane's open batch, fewer than ``size``, and the number of batches before it."""

    def __init__(self, size: int, pause: int, order: list[str], columns: list[str], types: T.StructType, lane: str):
        self.size, self.pause, self.order, self.columns, self.types, self.lane = size, pause, order, columns, types, lane

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lane", T.StructType([T.StructField("batches", T.LongType()), T.StructField("held", T.LongType())]))
        self.open = handle.getListState("open", self.types)

    def _closed(self, lane, rows: list[tuple], first: int, reason: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        out.insert(0, self.lane, lane)
        return out.assign(batch_id=first + np.arange(len(rows)) // self.size, closed_by=reason)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows, self.order)[self.columns]
        batches, held = self.state.get() if self.state.exists() else (0, 0)
        new = list(zip(*[pdf[c].astype(object).where(pdf[c].notna(), None).to_numpy() for c in self.columns]))
        full = (held + len(new)) // self.size
        if full:
            every = [tuple(r) for r in self.open.get()] + new if held else new
            yield self._closed(key[0], every[: full * self.size], batches, "count")
            rest = every[full * self.size :]
            _replace(self.open, rest)
            self._disarm()
        else:
            rest = new
            self.open.appendList(new)
        left = held + len(new) - full * self.size
        if left and (full or not held):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.pause)
        self.state.update((batches + full, left))

    def _disarm(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        batches, held = self.state.get() if self.state.exists() else (0, 0)
        if not held:
            return
        yield self._closed(key[0], [tuple(r) for r in self.open.get()], batches, "time")
        self.open.clear()
        self.state.update((batches + 1, 0))

    def close(self) -> None:
        pass


def micro_batches(df: DataFrame, lane: str, order: list[str], size: int = 1000, pause: str = "100 milliseconds") -> DataFrame:
    """Number the rows of each lane in batches that close at ``size`` rows, or ``pause`` after their first row came.

    Adds batch_id (from 0) and closed_by (count or time). The rows of a batch that is still open are in the state: run with a short
    ``every`` to have them closed by time, or take them with ``open_batches`` when the feed has ended. Deal a
    feed to lanes by a hash, so that all are about as busy; a lane's state holds fewer than ``size`` rows.
    """
    columns = [c for c in df.columns if c != lane]
    exact = _exact(df, columns)
    types = T.StructType([exact.schema[c] for c in columns])
    schema = T.StructType([df.schema[lane], *types.fields, T.StructField("batch_id", T.LongType()), T.StructField("closed_by", T.StringType())])
    processor = _Batches(size, int(pd.Timedelta(pause).total_seconds() * 1000), order, columns, types, lane)
    return _with_state(exact, [lane], processor, schema, "ProcessingTime").select(lane, *[F.col(c).cast(df.schema[c].dataType) for c in columns], "batch_id", "closed_by")


def open_batches(spark: SparkSession, checkpoint: str, schema: T.StructType, lane: str) -> DataFrame:
    """What a stopped query of ``micro_batches`` had not closed, as rows of its ``schema``: the flush at the end of a feed."""
    state = spark.read.format("statestore").option("path", checkpoint)
    rows = state.option("stateVarName", "open").load().select(F.col("key")[lane].alias(lane), "list_element.*")
    count = state.option("stateVarName", "lane").load().select(F.col("key")[lane].alias(lane), F.col("value.batches").alias("batch_id"))
    both = rows.join(count, lane).withColumn("closed_by", F.lit("end"))
    return both.select(*[F.col(f.name).cast(f.dataType) for f in schema])


# --- ids that are forgotten after a while -----------------------------------------------------------


class _Expiring(StatefulProcessor):
    """Holds the ids of a bucket that were let through, those of a micro-batch as one value, until their time to live is over."""

    def __init__(self, keep: int, key: str, order: list[str], columns: list[str], whole: list[str]):
        self.keep, self.key, self.order, self.columns, self.whole = keep, key, order, columns, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("at", T.LongType())]), PACKED, self.keep)

    def handleInputRows(self, key, rows, timerValues):
        pdf, ids, _, first = _by_key(rows, self.key, self.order, self.whole)
        now, new, again = timerValues.getCurrentProcessingTimeInMs(), set(ids), set()
        known = set()
        for (at,), (packed,) in self.seen.iterator():
            held = pickle.loads(bytes(packed))
            known |= new & held
            again = held if at == now else again
        if new - known:
            self.seen.updateValue((now,), (pickle.dumps(frozenset(again | (new - known)), pickle.HIGHEST_PROTOCOL),))
            yield pdf[self.columns].iloc[first[[n not in known for n in ids]]]

    def close(self) -> None:
        pass


def dedup_expiring(messages: DataFrame, keep: str = "60 seconds", key: str = "message_id", order: list[str] = ["seq"]) -> DataFrame:
    """First of every id; an id is forgotten ``keep`` after it was let through, by the clock, and is let through once more when it comes again.

    Repeated ids don't prolong that. State is the ids of the last ``keep``, and falls without new input.
    """
    filled = _fill(messages)
    processor = _Expiring(int(pd.Timedelta(keep).total_seconds() * 1000), key, order, filled.columns, _whole(messages.schema))
    passed = _with_state(filled.withColumn(BUCKET, _hash_bucket(key)), [BUCKET], processor, filled.schema, "ProcessingTime")
    return _unfill(passed, messages.schema)
