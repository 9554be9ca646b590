"""Helpers shared by the operators: flat views of text batches, rolling hashes, window anchors, interval merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once inside a task; a longer document is worked on alone.
CHUNK = 1 << 19

_SEEDS = np.random.default_rng(20240229)
_BYTE_VALUES = _SEEDS.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_SEEDS.integers(0, 1 << 60)) * 8 + 5
_POWERS: list[np.ndarray] = []


def row_hash(text: str = "text") -> Column:
    """Eight bytes of the text's MD5: tells apart rows that repeat a ``doc_id`` with another text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column of a table begins with: names made with it clash with none."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings (in UTF-8) or binaries of a batch and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, pa.scalar(b"", column.type) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]] if len(column) else raw[:0], at - at[0]


def chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, np.uint64(b)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers(max(len(values), 1))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Of each stretch of this length, by start."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n] if n else self.sums[:0])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = self.inverse[np.minimum(start, len(self.inverse) - 1)]
        return mixed((self.sums[end] - self.sums[start]) * inverse + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of word bytes, cut at document ends, and the first word of each document.

    ``is_word`` tells for each byte value whether it belongs to words.
    """
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, at)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by start."""
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:]) if len(low) > have else low[:0]
        have *= 2
    rest = width - have
    return low if not rest else np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]


#: Low bits of an anchor value that hold its place.
_PLACE = np.uint64((1 << 28) - 1)


def anchored_runs(grams: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Deal the windows of each item out to anchors: of a window's grams, the one with the least hash, leftmost first.

    Equal windows choose the same gram, wherever they stand. ``grams`` holds the hash of the gram at each place, ``at``
    the items' bounds. Returns the item, first window, number of windows and anchor of each run of neighbouring windows that
    share an anchor; places count from the beginning of the whole sequence.
    """
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~_PLACE) | (place & _PLACE), window - gram + 1)
    size = np.diff(at)
    held = np.maximum(size - window + 1, 0)
    item = np.repeat(np.arange(len(size)), held)
    starts = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(at[:-1], held)
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (item[1:] != item[:-1])
    first = np.flatnonzero(new)
    return item[first], starts[first], np.diff(np.append(first, len(starts))), anchor[first]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, touching ones joined, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def total(df: DataFrame, *aggregates: Column):
    """One row of sums over all rows."""
    return df.agg(*aggregates).first()
