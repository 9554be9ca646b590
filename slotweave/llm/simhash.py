"""SimHash near-duplicates: tiled exact comparison of fingerprints, then connected components.

Different fingerprints are sorted into tiles by the bit counts of their four 16-bit words. The counts of two fingerprints differ, summed
over the words, by no more than the fingerprints do, so tile pairs beyond the radius are skipped; the other pairs are compared
whole with exclusive-or and bit counts. A large tile is split into blocks. A pair of blocks gives a spanning forest
of its links, not all of them.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import free_prefix, row_hash
from slotweave.session import cut_lineage

#: Words of a fingerprint whose bits are counted, and the fingerprints of one block.
WORDS, BLOCK = 4, 2048
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if set in over half the shingles' hashes; no words: 0."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - shingle + 1)
    end = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])[:n].tolist()
    end = end[shingle - 1 :].tolist() if len(tokens) >= shingle else [len(joined)]
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, _SLICE):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[lo : lo + _SLICE], end[lo : lo + _SLICE])), "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, rid and fp (64 bits as a signed number) of every row."""

    def made(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(fp.view(np.int64))], names=["doc_id", "rid", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash().alias("rid"), "text").mapInArrow(made, "doc_id bigint, rid bigint, fp bigint")


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable place for each place, from labels so far and more links."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return label


def block_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest, as pairs of fingerprints, of the links between two blocks, or inside one (b: None)."""
    every = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(every))
    rows = max(1, (1 << 19) // max(len(other), 1))
    for lo in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[lo : lo + rows, None] ^ other[None, :]) <= radius)
        i = i + lo
        if b is None:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            label = _forest(label, i, j + shift)
    own = np.flatnonzero(label != np.arange(len(every)))
    return np.stack([every[own], every[label[own]]], 1)


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links a, b between different fingerprints, enough to connect all that differ in ``radius`` bits or fewer.

    ``fps`` has one row for each fingerprint.
    """
    base = 64 // WORDS + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", 64 // WORDS * k).bitwiseAND((1 << 64 // WORDS) - 1)) for k in range(WORDS)]
    tiled = fps.select("fp", F.struct(*[c.alias(f"c{k}") for k, c in enumerate(count)]).alias("tile"))
    sizes = tiled.groupBy("tile").count()  # at most 17**4 rows, whatever the input
    tiled = tiled.join(F.broadcast(sizes), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / BLOCK)))
    blocks = cut_lineage(tiled.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")))
    near = [d for d in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius and d >= (0,) * WORDS]
    shifted = F.array(*[F.struct(*[(F.col(f"tile.c{k}") + d[k]).cast("int").alias(f"c{k}") for k in range(WORDS)]) for d in near])
    inside = lambda t: F.least(*[t[f"c{k}"] for k in range(WORDS)]) >= 0
    within = lambda t: inside(t) & (F.greatest(*[t[f"c{k}"] for k in range(WORDS)]) < base)
    plain = F.struct(*[F.col(f"tile.c{k}").cast("int").alias(f"c{k}") for k in range(WORDS)]).alias("tile")
    many = sizes.select(plain, F.ceil(F.col("count") / BLOCK).alias("blocks"))
    left = blocks.select(F.col("tile").alias("own"), F.col("block").alias("own_block"), F.col("fps").alias("a"), F.explode(F.filter(shifted, within)).alias("tile"))
    same = F.col("own") == F.col("tile")
    # each pair of blocks is dealt by its second one, so a dense tile's pairs go to as many tasks as it has blocks
    first = F.when(same, F.col("own_block")).otherwise(0)
    left = left.join(F.broadcast(many), "tile").withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1)))
    right = blocks.select(plain, "block", F.col("fps").alias("b"))
    pairs = left.join(right, ["tile", "block"])
    pairs = pairs.select("a", F.when(~(same & (F.col("own_block") == F.col("block"))), F.col("b")).alias("b"))

    def compared(batches):
        for batch in batches:
            found = [np.empty((0, 2), np.uint64)]
            for k in range(batch.num_rows):
                a, b = (x.values.to_numpy().view(np.uint64) if x.is_valid else None for x in (batch.column("a")[k], batch.column("b")[k]))
                found.append(block_links(a, b, radius))
            out = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(compared, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) for all nodes of ``edges`` (a, b), by large and small stars.

    Each round links every node's larger neighbours, then its smaller ones, to the least of them; rounds grow with the
    logarithm of the longest chain.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m")).select("k.a", F.least("m", "k.a").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(edges.join(least, "a").select("a", F.col("m").alias("b")))
        large = cut_lineage(large.filter("a <> b").distinct())
        low = large.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m")).select("k.a", "m")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def grouped(docs: DataFrame, shingle: int, radius: int, seed: int) -> DataFrame:
    """doc_id, rid, fp and component_id of every row."""
    made = cut_lineage(fingerprints(docs, shingle, seed))
    different = cut_lineage(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(different, radius))
    rooted = different.join(roots, different["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    lowest = rooted.groupBy(F.struct("root").alias("k")).agg(F.min("least").alias("component_id")).select("k.root", "component_id")
    return made.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp")


def simhash_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the smallest doc_id reachable.

    Null, empty or white text: fingerprint zero, linked like any other. A null doc_id is never the smallest one; a component
    without other ids has a null component_id. Repeated rows: each is returned. Empty table: no rows. Other columns are not read.
    """
    return grouped(docs, shingle, radius, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of its smallest doc_id.

    Of rows that repeat id and text one stays. Components whose ids are all null stay whole, but for repeated texts.
    """
    stay = grouped(docs, shingle, radius, seed).filter("doc_id = component_id or component_id is null").select("doc_id", "rid").distinct()
    mark = free_prefix(docs.columns)
    rid, copy = mark + "rid", mark + "copy"
    own = docs.withColumn(rid, row_hash()).alias("d")
    both = own.join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{rid}") == F.col("s.rid")), "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", rid).orderBy(rid))
    return both.withColumn(copy, again).filter(F.col(copy) == 1).select(*(f"`{c}`" for c in docs.columns))
