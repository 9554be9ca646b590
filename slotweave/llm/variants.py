"""Spelling variants of words by blocked Gram matrices of letter counts.

Words of a length and the next one that agree in one half are a block: one edit leaves the first or the second half of the shorter
word as it is. NumPy products of a block's letter counts give the squared distances of all its words; pairs at most two apart are
candidates, since one edit changes one or two counts by one, and their edits are verified letter by letter. A large block is split,
and pairs of its parts are dealt to tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.session import cut_lineage

#: What words consist of: Latin-1 letters, and the two signs between them.
RUNS = "[a-zÀ-ÿ]"
#: Words of one part of a block, and letters in it; words multiplied at once when blocks are small.
PART, LETTERS, PACK = 2048, 1 << 20, 256
#: Words counted in a task before they are handed on.
HELD = 200_000
#: Comparisons dealt to one task.
WORK = 1 << 31

_COLUMN = np.full(256, 90, np.int64)  # of each letter's count; 90 is padding
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = np.arange(26, 90)


def runs(text: str, doc: int | None, least: int, every: int) -> list[str]:
    """Maximal runs of letters, A-Z lower-cased; of one in ``every`` by hash, one letter is left out."""
    lowered = text.encode().lower().decode()  # bytes: only A-Z change
    start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
    out = []
    for run in re.findall(f"{RUNS}{{{least},}}", lowered):
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= least:
            out.append(run)
    return out


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """word and n, its occurrences in all texts, of the words with enough letters and occurrences. Counted in the tasks first."""

    def emitted(held: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if text.is_valid:
                    held.update(runs(text.as_py(), doc, least_length, every))
                if len(held) >= HELD:
                    yield emitted(held)
                    held = Counter()
        if held:
            yield emitted(held)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _letters(words: list[bytes]) -> np.ndarray:
    """One row of Latin-1 letters per word, padded with 0."""
    table = np.array(words, dtype=bytes)
    return table.view(np.uint8).reshape(len(words), -1)


def _counts(letters: np.ndarray) -> np.ndarray:
    n, width = letters.shape
    cell = _COLUMN[letters] + np.arange(n)[:, None] * 91
    exact = np.float32 if width < 2048 else np.float64  # sums of squares stay whole numbers
    return np.bincount(cell.ravel(), minlength=n * 91).reshape(n, 91)[:, :90].astype(exact)


def edited_at(short: np.ndarray, long: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where ``long``, of ``other`` letters, departs from ``short``, of ``size``, by one replaced or inserted letter; -1 where it doesn't.

    Of several places an insertion can be at, the last one.
    """
    differs = short != long
    at = differs.argmax(1)
    replaced = (size == other) & (differs.sum(1) == 1)
    moved = np.zeros_like(differs)
    moved[:, :-1] = short[:, :-1] != long[:, 1:]
    inserted = (other == size + 1) & ~(moved & (np.arange(short.shape[1]) >= at[:, None])).any(1)
    return np.where(replaced | inserted, at, -1)


def near_pairs(words: list[bytes], block: np.ndarray, length: np.ndarray, head: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of all pairs of words of one block that are one edit apart, the shorter first.

    ``length`` is the block's lesser length and ``head`` whether its words agree in the first half. A pair that agrees in both halves belongs to the block
    of the first half, a pair of two longer words to their own length's. With ``part`` (0 or 1), only pairs of words of different parts.
    """
    letters = _letters(words)
    size = np.array([len(w) for w in words])
    counts = _counts(letters)
    shorter = np.flatnonzero(size == length)
    square = (counts * counts).sum(1)
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rows = max(1, (1 << 22) // max(len(words), 1))
    for lo in range(0, len(shorter), rows):
        own = shorter[lo : lo + rows]
        distance = square[own][:, None] + square[None, :] - 2 * (counts[own] @ counts.T)
        fit = (distance <= 2) & (block[own][:, None] == block[None, :])
        if part is not None:
            fit &= part[own][:, None] != part[None, :]
        i, j = np.nonzero(fit)
        i = own[i]
        once = (size[j] > size[i]) | (i < j)
        i, j = i[once], j[once]
        step = max(1, (1 << 23) // letters.shape[1])
        for k in range(0, len(i), step):
            a, b = i[k : k + step], j[k : k + step]
            at = edited_at(letters[a], letters[b], size[a], size[b])
            ok = (at >= 0) & ((at >= length[a] // 2) == head[a])
            found_i.append(a[ok])
            found_j.append(b[ok])
    return np.concatenate(found_i), np.concatenate(found_j)


def _best(words: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """For each word of some pairs: its near words, and the most frequent of them, the smallest in code-point order of equals."""
    own, other = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))  # Latin-1 bytes sort as code points do
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    text = lambda at: pa.array([words[k].decode("latin-1") for k in at], pa.string())
    return pa.RecordBatch.from_arrays(
        [text(own[first]), pa.array(np.diff(np.append(first, len(own)))), pa.array(-n[other[first]]), text(other[first])], names=["word", "n_near", "less", "form"]
    )


def _keys() -> Column:
    """The blocks of a word: as one of the shorter words and as one of the longer, by first and by second half."""
    blocks = []
    for length in (F.length("word"), F.length("word") - 1):
        half = F.floor(length / 2).cast("int")
        for head, agreed in ((True, F.substring(F.col("word"), F.lit(1), half)), (False, F.substring(F.col("word"), -(length - half), length))):
            key = F.xxhash64(length, F.lit(head), agreed)  # words that meet by a clash of hashes fail the test of their edits
            blocks.append(F.struct(key.alias("key"), length.alias("length"), F.lit(head).alias("head")))
    return F.array(*blocks)


def _packs(batch: pa.RecordBatch):
    """Rows [i, j) of a batch whose words are multiplied together: small blocks by the pack, larger ones and pairs of parts alone."""
    sizes, lengths, split, i = batch.column("size").to_numpy(), batch.column("length").to_numpy(), batch.column("split").to_pylist(), 0
    while i < len(sizes):
        j, words, longest = i + 1, sizes[i], lengths[i]
        while j < len(sizes) and not split[i] and not split[j] and words + sizes[j] <= PACK and (words + sizes[j]) * max(longest, lengths[j]) <= LETTERS:
            words, longest = words + sizes[j], max(longest, lengths[j])
            j += 1
        yield i, j
        i = j


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n and form, the most frequent near word, of the words of ``words`` (word, n) that have near ones."""
    keyed = words.select("word", "n", F.explode(_keys()).alias("k")).select("k.*", "word", "n")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max("length").alias("length")).filter("size > 1")
    parts = F.ceil(F.col("size") * F.greatest(F.lit(1.0), F.col("length") * PART / LETTERS) / PART).cast("int")
    sizes = cut_lineage(sizes.select("key", "size", parts.alias("parts")))
    work = sizes.agg(F.sum(F.least(F.col("size"), F.col("size") / F.col("parts") + PACK) * F.col("size"))).first()[0] or 0
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work // WORK) + 1)
    placed = keyed.join(sizes.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    blocks = placed.repartition(tasks, "key", "part").groupBy("key", "part").agg(
        F.first("parts").alias("parts"), F.first("length").alias("length"), F.first("head").alias("head"), F.collect_list(F.struct("word", "n")).alias("words"),
    )
    blocks = cut_lineage(blocks)
    others = F.sequence(F.col("part") + 1, F.col("parts") - 1)
    left = blocks.filter("part + 1 < parts").withColumn("other", F.explode(others)).repartition(tasks, "key", "part", "other")
    right = blocks.filter("part > 0").select("key", F.col("part").alias("other"), F.col("words").alias("words2"))
    columns = "length", "head", "words", "words2"
    alone = blocks.select("length", "head", "words", F.array().cast(blocks.schema["words"].dataType).alias("words2"))
    pairs = alone.unionByName(left.join(right, ["key", "other"]).select(*columns))
    pairs = pairs.select(*columns, (F.size("words") + F.size("words2")).alias("size"), (F.size("words2") > 0).alias("split"))

    def compared(batches):
        for batch in batches:
            for i, j in _packs(batch):
                rows = batch.slice(i, j - i).to_pylist()
                held = [w for r in rows for w in r["words"] + r["words2"]]
                if len(held) < 2:
                    continue
                own, n, size = [w["word"].encode("latin-1") for w in held], np.array([w["n"] for w in held], np.int64), [r["size"] for r in rows]
                block = np.repeat(np.arange(len(rows)), size)
                length, head = (np.repeat([r[c] for r in rows], size) for c in ("length", "head"))
                part = np.repeat([0, 1], [len(rows[0]["words"]), len(rows[0]["words2"])]) if rows[0]["split"] else None
                a, b = near_pairs(own, block, length, head, part)
                if len(a):
                    yield _best(own, n, a, b)

    found = pairs.mapInArrow(compared, "word string, n_near bigint, less bigint, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows word, form: forms followed to the last one. Each round doubles the steps taken.

    A form is ten times as frequent as its word, so a chain is as long as the digits of a count. Near words of one word are
    bounded by its letters, so no form has more rows than that.
    """
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not further.filter("moved").limit(1).count():
            return further.select("word", "root")
        reached = further.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, factor: int = 10, every: int = 31) -> DataFrame:
    """Group the words of all texts of ``docs`` (doc_id, text) by their spelling.

    Words are the runs of ``RUNS``, A-Z lower-cased, of ``least_length`` letters or more that occur ``least_count`` times or more; of one
    run in ``every``, by the CRC-32 of ``<doc_id>:<run>``, one letter is left out first (``every`` beyond 2**32: hardly any).
    Two words are near if one inserted, deleted or replaced letter makes one the other. Returns word, form (the near word of most occurrences, the smallest in code-point order
    of equals, if it has ``factor`` times the word's or more; else null), root (forms followed to the last; the word itself without any), n, n_near
    (near words) and form_n (occurrences of form).

    Null or empty text, or no table rows: no words. A null doc_id counts as an empty one. Repeated rows: each counts. Runs
    of any length are words. Other columns are not read.
    """
    words = cut_lineage(vocabulary(docs, least_length, least_count, every))
    joined = words.join(near_words(words), "word", "left")
    fits = F.col("form_n") >= factor * F.col("n")
    judged = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    judged = cut_lineage(judged)
    led = roots(judged.filter("form is not null"))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
