"""Removal of byte strings that occur twice, by suffix arrays of shards.

A window is ``length`` bytes of one text. Every window is dealt to an anchor: of the shorter grams it contains, the one with the
least hash. Equal windows have equal anchors, so a window whose anchor's gram occurs once is unique, and windows of different
anchors need not be compared. Neighbouring windows of one anchor form a segment.

1. Segments are rows of numbers; those of grams that occur once go, and equal segments are counted before anything is gathered.
2. For grams with different segments, of which some occurs once, the text of each different segment goes to a shard by its
   gram. A shard's suffix array is induced, its permuted common prefixes tell which windows occur again.
3. Grams with more than ``shard_bytes`` of different segments would make one shard grow. Their segments are texts of their own for the same steps with a
   longer gram, which tells more of their windows apart, and so on up to grams of a whole window.
4. Marks go back to all holders of a segment, and each text is cut once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import CHUNK, Rolling, anchored_runs, byte_values, chunks, flat, merged, row_hash, signed
from slotweave.llm.induced import common_prefixes, suffix_array
from slotweave.session import cut_lineage

SEGMENT = "doc_id bigint, rid bigint, start int, run int, off int, key bigint, d1 bigint, d2 bigint"
CONTENT = ["key", "d1", "d2"]
#: A longer text is cut into overlapping pieces while its segments are listed.
PIECE = 1 << 22


def _stretches(at: np.ndarray, overlap: int, size: int):
    """(first row, begin, bounds from there, bytes of the row before begin)."""
    for i, j in chunks(at, min(size, CHUNK)):
        if j == i + 1 and at[j] - at[i] > size:
            for p in range(0, int(at[j] - at[i]), size):
                yield i, at[i] + p, np.array([0, min(size + overlap, at[j] - at[i] - p)]), p
        else:
            yield i, at[i], at[i : j + 1] - at[i], 0


def segments(docs: DataFrame, length: int, gram: int, size: int = PIECE) -> DataFrame:
    """Rows of SEGMENT for all windows of all texts; ``off`` is the anchor's distance from the start. Texts over ``size`` bytes are listed by pieces."""

    def listed(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            for i, begin, own, shift in _stretches(at, length - 1, size):
                piece = data[begin : begin + own[-1]]
                grams = Rolling(byte_values(piece)).windows(gram)
                item, start, run, anchor = anchored_runs(grams, own, length, gram)
                if not len(item):
                    continue
                view, end = memoryview(np.ascontiguousarray(piece)), start + run + length - 1
                digest = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
                digest = np.frombuffer(digest, np.int64).reshape(-1, 2)
                rows = pa.array(item + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows), batch.column("rid").take(rows),
                        pa.array((start - own[item] + shift).astype(np.int32)), pa.array(run.astype(np.int32)), pa.array((anchor - start).astype(np.int32)),
                        pa.array(signed(grams[anchor])), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                    ],
                    names=[c.split()[0] for c in SEGMENT.split(", ")],
                )

    return docs.mapInArrow(listed, SEGMENT)


def _bodies(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of segments: each is read from the one holder that ``wanted`` names."""
    per_text = wanted.groupBy("doc_id", "rid").agg(F.collect_list(F.struct(*CONTENT, "start", "run")).alias("parts"))
    both = docs.alias("d").join(per_text.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.rid") == F.col("p.rid")))

    def sliced(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            for begin, parts in zip(at.tolist(), batch.column("parts").to_pylist()):
                for lo in range(0, len(parts), 4096):
                    some = parts[lo : lo + 4096]
                    body = [data[begin + p["start"] : begin + p["start"] + p["run"] + length - 1].tobytes() for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in some], pa.int64()) for c in CONTENT] + [pa.array(body, pa.binary())], names=[*CONTENT, "body"])

    return both.select("text", "parts").mapInArrow(sliced, "key bigint, d1 bigint, d2 bigint, body binary")


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """Starts in each body of the windows that start anywhere else in these bodies."""
    sizes = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 2
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    text[bounds[1:] - 1] = 1
    text = np.append(text, 0)
    before, shared = common_prefixes(text, suffix_array(text))
    again = shared >= length
    again[before[again]] = True
    out = []
    for i, n in enumerate(sizes):
        out.append(np.flatnonzero(again[bounds[i] : bounds[i] + max(n - length + 1, 0)]))
    return out


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)]


def _by_shard(bodies: DataFrame, length: int, shards: int) -> DataFrame:
    def marked(table: pd.DataFrame) -> pd.DataFrame:
        table = table.drop_duplicates(CONTENT)
        out = []
        for own, starts in zip(table[CONTENT].itertuples(index=False), repeated_starts(list(table["body"]), length)):
            if len(starts):
                out += [(*own, a, b) for a, b in zip(*_runs(starts))]
        return pd.DataFrame(out, columns=[*CONTENT, "lo", "hi"])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return bodies.select(shard, *CONTENT, "body").groupBy("shard").applyInPandas(marked, "key bigint, d1 bigint, d2 bigint, lo int, hi int")


def longer(gram: int, length: int) -> int:
    """The next gram: half-way to the whole window."""
    return gram + (length - gram + 1) // 2


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 96, shard_bytes: int = 1 << 20, size: int = PIECE) -> DataFrame:
    """Rows doc_id, rid, spans: byte intervals [lo, hi) covered by windows that occur elsewhere; texts without any are left out.

    ``docs`` has doc_id, rid and text. A row's identity is (doc_id, rid); rows that repeat both are equal and get equal spans.
    """
    listed = cut_lineage(segments(docs, length, gram, size))
    often = listed.groupBy(F.struct("key").alias("k")).agg(F.count("*").alias("n")).filter("n > 1").select("k.key")
    held = cut_lineage(listed.join(often, "key"))
    content = held.groupBy(*CONTENT).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "start", "run")).alias("first"))
    content = cut_lineage(content.select(*CONTENT, "copies", "first.*"))
    body_bytes = F.sum(F.col("run") + (length - 1))
    per_key = content.groupBy(F.struct("key").alias("k")).agg(F.count("*").alias("different"), F.min("copies").alias("least"), body_bytes.alias("bytes"))
    # different segments of a gram as long as the window are clashes of its hash
    bounded = F.col("bytes") if gram < length else F.lit(0).cast("bigint").alias("bytes")
    open_ = per_key.filter("different > 1 and least = 1").select("k.key", bounded)
    wanted = cut_lineage(content.join(open_, "key"))
    sums = wanted.agg(F.sum(F.when(F.col("bytes") <= shard_bytes, F.col("run") + (length - 1))), F.count(F.when(F.col("bytes") > shard_bytes, 1))).first()
    marks = content.filter("copies > 1").select(*CONTENT, F.lit(0).alias("lo"), (F.col("run") - 1).alias("hi"))
    if sums[0] or sums[1]:
        bodies = cut_lineage(_bodies(docs, wanted, length).join(wanted.select(*CONTENT, "bytes", "copies"), CONTENT))
        found = []
        if sums[0]:
            found.append(_by_shard(bodies.filter(F.col("bytes") <= shard_bytes), length, -(-sums[0] // shard_bytes)))
        if sums[1]:
            large = bodies.filter(F.col("bytes") > shard_bytes)
            texts = large.select(F.col("d1").alias("doc_id"), F.col("d2").alias("rid"), F.col("body").alias("text"))
            deeper = repeated_spans(texts, length, longer(gram, length), shard_bytes, size).withColumn("span", F.explode("spans"))
            own = deeper.select(F.col("doc_id").alias("d1"), F.col("rid").alias("d2"), F.col("span.lo").alias("lo"), (F.col("span.hi") - length).alias("hi"))
            found.append(large.select(*CONTENT).join(own, ["d1", "d2"]).select(*CONTENT, "lo", "hi"))
        for more in found:
            marks = marks.unionByName(more)
    spans = held.join(marks, CONTENT).select("doc_id", "rid", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + length).alias("hi")).alias("span"))
    return spans.groupBy("doc_id", "rid").agg(F.collect_set("span").alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 96, shard_bytes: int = 1 << 20, keep_text: bool = True, size: int = PIECE) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts elsewhere in ``docs`` (doc_id, text).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, the remaining bytes ``kept``.

    Null text: empty, with the digest of nothing. Texts under ``length`` bytes: whole. Null or repeated doc_id: every row is judged and
    returned as a document of its own; repeated rows are copies of one another. Empty table: no rows. Other columns are
    not read.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash().alias("rid"), "text")
    spans = repeated_spans(slim, length, gram, shard_bytes, size)
    both = slim.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.rid") == F.col("s.rid")), "left")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            n = len(at) - 1
            removed, runs, digests, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[at[i] : at[i + 1]]
                if spans:
                    lo, hi = merged(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
                    removed[i], runs[i] = (hi - lo).sum(), len(lo)
                    text = np.concatenate([text[a:b] for a, b in zip(np.append(0, hi), np.append(lo, len(text)))])
                digests.append(hashlib.sha256(np.ascontiguousarray(text)).hexdigest())
                if keep_text:
                    kept.append(text.tobytes())
            columns = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed), pa.array(runs), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, names=[c.split()[0] for c in schema.split(", ")])

    return both.select("d.doc_id", "text", "spans").mapInArrow(cut, schema)
