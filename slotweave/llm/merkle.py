"""Document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs are lines, longer ones cut at sentence ends; they are grouped into sections at content-chosen places, so an edit moves no
boundary far from it. A node's hash covers its children's, so equal roots mean equal texts and differing branches lead to the edits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of a paragraph's, a section's and the root's hash.
LEAF, SECTION, ROOT = 10, 12, 32
#: A paragraph ends at a line end, or after a sentence end; without these, at a space after this many characters.
LONG = 64
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]")


def paragraphs(text: str) -> list[str]:
    """The text in pieces, nothing left out; one walk over it, whatever it holds."""
    out = []
    for line in _LINE.finditer(text):
        begin, end = line.span()
        for cut in (*(m.end() for m in _SENTENCE.finditer(text, begin, end)), end):
            while cut - begin > LONG:
                at = text.find(" ", begin + LONG // 2, begin + LONG) + 1 or begin + LONG
                out.append(text[begin:at])
                begin = at
            if cut > begin:
                out.append(text[begin:cut])
            begin = cut
    return out


def _hash(raw: bytes, digits: int) -> str:
    return hashlib.blake2b(raw, digest_size=16).hexdigest()[:digits]


def fingerprint(text: str | None) -> str:
    """``root:section=paragraph.weight,...;section=...`` with weights in characters; the empty text has a root only."""
    sections, own = [], []
    for part in paragraphs(text or ""):
        leaf = _hash(part.encode(), 32)
        own.append((leaf, len(part)))
        if leaf[-2] in "048c" and leaf[-1] in "02468ace":  # one in eight paragraphs ends a section
            sections.append(own)
            own = []
    if own:
        sections.append(own)
    nodes = [_hash("".join(f"{leaf}{n:x}." for leaf, n in s).encode(), 32) for s in sections]
    root = _hash("".join(nodes).encode(), ROOT)
    return root + ":" + ";".join(node[:SECTION] + "=" + ",".join(f"{leaf[:LEAF]}.{n:x}" for leaf, n in s) for node, s in zip(nodes, sections))


def parse(tree: str) -> tuple[str, list[tuple[str, list[tuple[str, int]]]]]:
    """Root, and sections as (hash, [(paragraph hash, weight)])."""
    root, _, rest = tree.partition(":")
    sections = []
    for part in rest.split(";") if rest else []:
        node, _, leaves = part.partition("=")
        sections.append((node, [(x.partition(".")[0], int(x.partition(".")[2], 16)) for x in leaves.split(",")]))
    return root, sections


def likeness(a: str, b: str) -> float:
    """Characters in paragraphs that both have, as a share of the longer text's: equal roots end the descent, then equal sections."""
    (root_a, own_a), (root_b, own_b) = parse(a), parse(b)
    if root_a == root_b:
        return 1.0
    size = max(sum(n for _, s in own for _, n in s) for own in (own_a, own_b))
    sections_a, sections_b = Counter(node for node, _ in own_a), Counter(node for node, _ in own_b)
    equal = sections_a & sections_b
    shared, left = 0, []
    for own in (own_a, own_b):
        rest, paired, leaves = equal.copy(), 0, Counter()
        for node, s in own:
            if rest[node]:
                rest[node] -= 1
                paired += sum(n for _, n in s)
            else:
                leaves.update(s)
        left.append(leaves)
        shared = paired
    common = left[0] & left[1]
    return (shared + sum(n * k for (_, n), k in common.items())) / size if size else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Character intervals of the first text whose paragraphs the second lacks: only sections that differ are opened."""
    (root_a, own_a), (root_b, own_b) = parse(a), parse(b)
    if root_a == root_b:
        return []
    sections = Counter(node for node, _ in own_b)
    leaves = Counter(x for _, s in own_b for x in s)
    out, at = [], 0
    for node, s in own_a:
        whole = sections[node] > 0
        sections[node] -= whole
        for x in s:
            has = leaves[x] > 0
            leaves[x] -= has
            if not (whole or has):
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + x[1])
                else:
                    out.append((at, at + x[1]))
            at += x[1]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text). Null text: as empty. Other columns are not read."""

    def made(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(made, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many characters of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(value, cuts: list[int], shift: int = 0):
    """How many of the ascending cuts are no larger than the value, by halving."""
    if not cuts:
        return F.lit(shift)
    mid = len(cuts) // 2
    return F.when(value < cuts[mid], _range_of(value, cuts[:mid], shift)).otherwise(_range_of(value, cuts[mid + 1 :], shift + mid + 1))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in ranges of doc_id, each in order; column ``tail`` marks a copy of the row that follows a range.

    The ids of the ranges' first rows, ``parts`` at most, pass through the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted({int(c) for c in docs.filter("doc_id is not null").stat.approxQuantile("doc_id", shares, 0.2 / parts)}) if shares else []
    value = F.col("doc_id")
    ranged = docs.withColumn("part", F.when(value.isNull(), 0).otherwise(_range_of(value, cuts)))  # a null id comes first
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("least"), F.max(value.isNull()).alias("nulls")).orderBy("part").collect()
    order = [r["part"] for r in firsts]
    rows = [(r["part"], None if r["nulls"] else r["least"], before) for r, before in zip(firsts, order[-1:] + order[:-1])]
    first = spark.createDataFrame(rows, "part int, least bigint, before int")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("before").alias("part"), F.lit(True).alias("tail"))
    places = F.when(value.eqNullSafe(F.col("least")), F.array(own, tail)).otherwise(F.array(own))
    spread = ranged.join(F.broadcast(first), "part").select("doc_id", "text", F.inline(places))
    return spread.repartitionById(parts, "part").sortWithinPartitions("part", "tail", "doc_id", "text")


def compare_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every row of ``docs`` (doc_id, text) and its edit with the next row, in ascending doc_id and then text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness of the fingerprints, 0 to
    1) and edited_from: the first character that the trees show to differ, null if none does.

    Null text: empty. A null doc_id comes first. Repeated doc_id: by text. The last row is followed by the first; a single
    row by itself. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = parts or min(2000, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_from bigint"

    def judged(batches):
        held = None  # doc_id, text, tree and part of the row that waits for the next one
        for batch in batches:
            out = []
            for doc, text, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail"))):
                if held and held[3] != part:
                    held = None
                if tail and not held:
                    continue
                tree = fingerprint(text)
                if held:
                    new = edited(held[1], text)
                    own = fingerprint(new)
                    moved = differing(held[2], own)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), held[2], own, likeness(held[2], own), likeness(held[2], tree), moved[0][0] if moved else None))
                held = None if tail else (doc, text, tree, part)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return with_next(slim, parts).mapInArrow(judged, schema)
