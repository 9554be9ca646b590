"""Benchmark decontamination by an FM-index of each training shard.

A shard is some documents of one task. Its words become symbols; only stretches of words that test phrases use can hold one, so these are
indexed, with a break between them. Phrases are searched backwards, all at once, through ranks in a wavelet matrix of the
shard's Burrows-Wheeler transform; occurrences are located from sampled suffix positions, and their spans are merged per document.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import Rolling, byte_values, chunks, flat, free_prefix, merged, mixed, row_hash, words
from slotweave.llm.induced import suffix_array
from slotweave.session import cut_lineage

_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
IS_WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
#: Bytes of text in one shard, and how sparsely suffix positions are kept.
SHARD, SAMPLE = 1 << 22, 8
#: Bytes of benchmark text whose phrases workers hold at once; a larger benchmark is searched in several passes over the documents.
HELD = 1 << 26
_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def word_hashes(data: np.ndarray, at: np.ndarray):
    """Hash, start and end byte of every word of the lower-cased texts, and each text's first word."""
    low = _LOWER[data]
    start, end, first = words(low, at, IS_WORD)
    return Rolling(byte_values(low)).spans(start, end), start, end, first


@dataclass
class Phrases:
    """Test phrases as symbols (rank of the word's hash in ``vocabulary``, from 1), and the items each belongs to."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    length: np.ndarray
    item_from: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(rows: list[tuple[str | None, str | None]], window: int) -> Phrases:
    """All windows of all items; an item of fewer words is one. Items with one id are one item; a null id reads as empty."""
    names = sorted({"" if i is None else str(i) for i, _ in rows})
    number = {x: k for k, x in enumerate(names)}
    texts = pa.array([t for _, t in rows], pa.string())
    h, _, _, first = word_hashes(*flat(texts))
    vocabulary = np.unique(h)
    symbol = np.searchsorted(vocabulary, h) + 1
    found: dict[tuple, set] = {}
    for (name, _), lo, hi in zip(rows, first[:-1].tolist(), first[1:].tolist()):
        size = min(window, hi - lo)
        for k in range(lo, hi - size + 1 if size else lo):
            found.setdefault(tuple(symbol[k : k + size].tolist()), set()).add(number["" if name is None else str(name)])
    table = np.zeros((len(found), window), np.int64)
    for row, key in zip(table, found):
        row[window - len(key) :] = key
    counts = np.array([len(x) for x in found.values()], np.int64)
    items = np.array([i for x in found.values() for i in sorted(x)], np.int64)
    return Phrases(vocabulary, table, np.array([len(k) for k in found], np.int64), np.concatenate([[0], np.cumsum(counts)]), items, names)


class FMIndex:
    """Burrows-Wheeler transform of one sequence in a wavelet matrix, with every SAMPLE-th suffix position."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        array = suffix_array(text)
        bwt = text[array - 1]
        top = int(text.max()) if len(text) else 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits, self.zeros = [], []
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            ones = np.zeros(len(bwt) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.bits.append((level, ones))
            self.zeros.append(len(bwt) - int(ones[-1]))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.kept = array % SAMPLE == 0
        self.rank_kept = np.concatenate([[0], np.cumsum(self.kept)])
        self.samples = array[self.kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        start = np.zeros_like(i)
        for (level, ones), zeros in zip(self.bits, self.zeros):
            bit = (symbol >> level & 1).astype(bool)
            i = np.where(bit, zeros + ones[i], i - ones[i])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return i - start

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        symbol, start, i = np.zeros_like(row), np.zeros_like(row), row
        for (level, ones), zeros in zip(self.bits, self.zeros):
            bit = ones[i + 1] > ones[i]
            symbol |= bit.astype(np.int64) << level
            i = np.where(bit, zeros + ones[i], i - ones[i])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return self.before[symbol] + i - start

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern; patterns are right-aligned."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for k in range(1, patterns.shape[1] + 1):
            live = live[length[live] >= k]
            symbol = patterns[live, -k]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
            gone = high[live] <= low[live]
            high[live[gone]] = low[live[gone]]
            live = live[~gone]
        return low, np.where(high > low, high, low)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Position of the suffix in each row."""
        position, steps, live = np.zeros_like(row), np.zeros_like(row), np.arange(len(row))
        row = row.copy()
        while len(live):
            there = self.kept[row[live]]
            done = live[there]
            position[done] = self.samples[self.rank_kept[row[done]]] + steps[done]
            live = live[~there]
            row[live] = self.step(row[live])
            steps[live] += 1
        return position


def occurrences(hashes: np.ndarray, first: np.ndarray, test: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase number of every occurrence in a shard of documents, whose words' hashes are given."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(test.vocabulary) or not len(hashes):
        return nothing
    symbol = np.searchsorted(test.vocabulary, hashes)
    symbol = np.where(test.vocabulary[np.minimum(symbol, len(test.vocabulary) - 1)] == hashes, symbol + 1, 0)
    known = symbol > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    begins[first[:-1][first[:-1] < len(known)]] = known[first[:-1][first[:-1] < len(known)]]
    run = np.cumsum(begins) - 1
    sizes = np.bincount(run[known], minlength=int(begins.sum()))
    keep = known.copy()
    keep[known] = sizes[run[known]] >= test.length.min()
    place = np.flatnonzero(keep)
    if not len(place):
        return nothing
    fresh = np.append(True, run[place][1:] != run[place][:-1])
    at = np.arange(len(place)) + np.cumsum(fresh) - 1  # one break before each further stretch
    text = np.ones(at[-1] + 2, np.int64)
    text[at] = symbol[place] + 1
    text[-1] = 0
    word = np.zeros(len(text), np.int64)
    word[at] = place
    index = FMIndex(text)
    inside = test.symbols.max(1) + 1 < len(index.before) - 1
    low, high = index.search(np.where(inside[:, None], test.symbols + 1, 1), np.where(inside, test.length, 0))
    count = np.where(inside, high - low, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return word[index.locate(rows)], phrase


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list]:
    """The test set in blocks of about ``block_bytes`` of text, one after the other through the driver."""
    slim = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = max(1, -(-_text_bytes(slim) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in slim.filter(block == k).collect()]


def _judge(shipped: list, data: np.ndarray, at: np.ndarray, scale: int):
    """For the documents of one shard: number of words and of hits, items found, spans of hits, and whether each is contaminated."""
    hashes, _, _, first = word_hashes(data, at)
    docs = len(at) - 1
    cover = np.zeros(len(hashes) + 1, np.int64)
    items: list[set] = [set() for _ in range(docs)]
    for block in shipped:
        test = block.value
        place, phrase = occurrences(hashes, first, test)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + test.length[phrase], -1)
        doc = np.searchsorted(first, place, "right") - 1
        for pair in np.unique(doc * max(len(test.length), 1) + phrase).tolist():
            d, p = divmod(pair, len(test.length))
            items[d].update(test.names[x] for x in test.items[test.item_from[p] : test.item_from[p + 1]])
    hit = np.cumsum(cover[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_words, n_hit = np.diff(first), np.diff(sums[first])
    spans: list[list] = [[] for _ in range(docs)]
    for d in np.flatnonzero(n_hit):
        own = np.diff(np.concatenate([[0], hit[first[d] : first[d + 1]].astype(np.int8), [0]]))
        spans[d] = [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(own > 0), np.flatnonzero(own < 0))]
    return n_words, n_hit, items, spans, (n_hit > 0) & (scale * n_hit >= n_words)


def _text_bytes(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _shipped(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    context = docs.sparkSession.sparkContext
    return [context.broadcast(phrases(rows, window)) for rows in _blocks(benchmark, block_bytes)]


def _by_passes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """doc_id, rid, spans and items of the documents (doc_id, rid, text) with hits: one pass and one broadcast for each block."""
    context, found = docs.sparkSession.sparkContext, []

    def hits_of(test):
        def hits(batches):
            for batch in batches:
                data, at = flat(batch.column("text"))
                for i, j in chunks(at, SHARD):
                    _, n_hit, items, spans, _ = _judge([test], data[at[i] : at[j]], at[i : j + 1] - at[i], 1)
                    some = np.flatnonzero(n_hit).tolist()
                    columns = [batch.column(c).slice(i, j - i).take(pa.array(some, pa.int64())) for c in ("doc_id", "rid")]
                    columns += [pa.array([spans[k] for k in some], _SPANS), pa.array([sorted(items[k]) for k in some], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "spans", "items"])

        return hits

    for rows in _blocks(benchmark, block_bytes):
        test = context.broadcast(phrases(rows, window))
        found.append(cut_lineage(docs.mapInArrow(hits_of(test), "doc_id bigint, rid bigint, spans array<struct<lo:bigint,hi:bigint>>, items array<string>").distinct()))
        test.destroy()
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _summed(data: np.ndarray, at: np.ndarray, spans: list, items: list, scale: int):
    """As ``_judge``, of spans and items that passes have found."""
    n_words = np.diff(word_hashes(data, at)[3])
    both = [merged(np.array([s["lo"] for s in x]), np.array([s["hi"] for s in x])) if x else ((), ()) for x in spans]
    n_hit = np.array([int(np.sum(hi) - np.sum(lo)) for lo, hi in both], np.int64)
    joined = [[{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi)] for lo, hi in both]
    return n_words, n_hit, [set(x or ()) for x in items], joined, (n_hit > 0) & (scale * n_hit >= n_words)


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, scale: int):
    """The documents, with columns ``spans`` and ``items`` behind a mark if found by passes, and a judge of a part of a batch."""
    if _text_bytes(benchmark) <= HELD:
        shipped = _shipped(docs, benchmark, window, block_bytes)
        return docs, lambda batch, data, at: _judge(shipped, data, at, scale)
    mark = free_prefix(docs.columns)
    own = docs.withColumn(mark + "rid", row_hash())
    found = _by_passes(own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(mark + "rid").alias("rid"), "text"), benchmark, window, min(block_bytes, HELD))
    found = found.select(*[F.col(c).alias(mark + c) for c in ("doc_id", "spans", "items")], F.col("rid").alias(mark + "row"))
    both = own.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col(mark + "doc_id")) & (F.col(mark + "rid") == F.col(mark + "row")), "left")
    both = both.select(*(f"`{c}`" for c in docs.columns), mark + "spans", mark + "items")
    return both, lambda batch, data, at: _summed(data, at, batch.column(mark + "spans").to_pylist(), batch.column(mark + "items").to_pylist(), scale)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.05, block_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with what it shares with ``benchmark`` (item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated and ``spans`` (merged word intervals [lo, hi) to remove).
    Words are digits, letters and all non-ASCII characters, lower-cased in A-Z; a hit lies in an occurrence of ``window``
    consecutive words of an item, or of the whole of a shorter item; a document is contaminated if hits are at least
    ``min_share`` of its words and there are any.

    The documents are not shuffled. The benchmark goes to the tasks in blocks of ``block_bytes``, each an own broadcast; a task searches
    one block after the other. Beyond ``HELD`` bytes each block has its own pass over the documents, and what the passes find is joined to them.

    Null or empty text: no words, on either side. A null item_id reads as the empty string; items that repeat an id are one. Null or
    repeated doc_id: each row is judged alone. Empty tables: no rows, or no hits. Other columns are not read.
    """
    scale = round(1 / min_share)
    read, judge = _judged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, window, block_bytes, scale)
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<lo:bigint,hi:bigint>>"

    def judged(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            for i, j in chunks(at, SHARD):
                n_words, n_hit, items, spans, bad = judge(batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i])
                digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i)]
                    + [pa.array(x) for x in (n_words, n_hit, np.array([len(x) for x in items], np.int64))]
                    + [pa.array(digests, pa.string()), pa.array(bad), pa.array(spans, _SPANS)],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

    return read.mapInArrow(judged, schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.05, block_bytes: int = 1 << 24) -> DataFrame:
    """The rows of ``docs``, all columns and unchanged, that ``find_contamination`` does not call contaminated."""
    read, judge = _judged(docs, benchmark, window, block_bytes, round(1 / min_share))
    names = docs.columns

    def kept(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            own = pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names)
            for i, j in chunks(at, SHARD):
                bad = judge(batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i])[-1]
                yield own.slice(i, j - i).filter(pa.array(~bad))

    return read.mapInArrow(kept, docs.schema)


def without_spans(text: str | None, spans) -> str:
    """The text without the words of ``spans``, from the first byte of each span's first word to the last of its last."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    _, start, end, _ = word_hashes(data, np.array([0, len(raw)]))
    lo, hi = merged(np.array([s["lo"] for s in spans], np.int64), np.array([s["hi"] for s in spans], np.int64))
    cut = zip([0, *end[hi - 1].tolist()], [*start[lo].tolist(), len(raw)])
    return b"".join(raw[a:b] for a, b in cut).decode()
