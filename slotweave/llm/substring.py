"""Removal of word passages that an earlier document has, by level-wise doubling.

Windows of ``first`` words that occur in two documents are candidates; only these are extended to twice the length, and so on up to
``window`` words, until no candidates survive. At the first length not every window is listed: each window of ``window`` words is
dealt to the shortest-level window in it with the least hash, so equal long windows are dealt to equal short ones. Neighbouring windows of
one short window form a run; each level splits the surviving runs so that what its windows have in common is twice as long.
Equal runs are a class. A run that repeats itself without a gap, as periodic text does, is one row with a number of times; and classes that follow one
another wherever they occur are one stretch. So a passage costs each of its holders a row, however long it is. Everything is grouped by hashes with partial aggregation; no group is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import Rolling, anchored_runs, byte_values, chunks, flat, free_prefix, merged, mixed, row_hash, signed, words
from slotweave.session import cut_lineage, drop_folder, hand_over

#: Words are separated by these bytes.
SPACES = b" \t\n\r\x0b\x0c"
IS_WORD = ~np.isin(np.arange(256), list(SPACES))
RUN = "doc_id bigint, rid bigint, start int, run int, off int, key bigint, digest bigint, next bigint, times int"
CONTENT = ["key", "digest"]


def _hashed(piece: np.ndarray, own: np.ndarray) -> tuple[Rolling, np.ndarray]:
    """Rolling hashes over the words of some texts, and the first word of each."""
    start, end, at = words(piece, own, IS_WORD)
    return Rolling(mixed(Rolling(byte_values(piece)).spans(start, end))), at


def _listed(docs: DataFrame, window: int, first: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            for i, j in chunks(at):
                rolling, own = _hashed(data[at[i] : at[j]], at[i : j + 1] - at[i])
                grams = rolling.windows(first)
                item, start, run, anchor = anchored_runs(grams, own, window, first)
                if not len(item):
                    continue
                digest = rolling.spans(start, start + run + window - 1)
                again = (item[1:] == item[:-1]) & (digest[1:] == digest[:-1])
                kept = np.flatnonzero(np.append(True, ~again))
                times = np.diff(np.append(kept, len(item)))
                item, start, run, anchor, digest = (x[kept] for x in (item, start, run, anchor, digest))
                following = np.append(digest[1:], np.uint64(0))  # of the run behind; 0 behind a text's last one
                following[:-1][item[1:] != item[:-1]] = 0
                at_row = pa.array(item + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at_row), batch.column("rid").take(at_row)]
                    + [pa.array(x.astype(np.int32)) for x in (start - own[item], run, anchor - start)]
                    + [pa.array(signed(x)) for x in (grams[anchor], digest, following)]
                    + [pa.array(times.astype(np.int32))],
                    names=[c.split()[0] for c in RUN.split(", ")],
                )

    return docs.mapInArrow(rows, RUN)


def levels(window: int, first: int) -> list[int]:
    """Lengths between the first and the last: each twice the one before."""
    out = [2 * first]
    while out[-1] * 2 <= window:
        out.append(2 * out[-1])
    return [n for n in out if n < window]


def _extended(docs: DataFrame, wanted: DataFrame, window: int, between: list[int]) -> DataFrame:
    """The windows of candidate runs, in classes; ``common`` has the hash of what a class's windows share at each level."""
    per_text = wanted.groupBy("doc_id", "rid").agg(F.collect_set(F.struct(*CONTENT, "start", "run", "off")).alias("parts"))
    both = docs.join(per_text, ["doc_id", "rid"]).select("doc_id", "text", "parts")
    widths = [window - n + 1 for n in between] or [1 << 30]

    def rows(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            for i, (doc, parts) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist())):
                rolling, _ = _hashed(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
                every = signed(rolling.windows(window))
                out = []
                for p in parts:
                    off = p["off"] - np.arange(p["run"])  # the anchor's distance from each window's start, falling
                    cuts = np.flatnonzero(np.any([np.diff(off // w) for w in widths], axis=0)) + 1  # widths do not nest: a piece is in one class at every level
                    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), p["run"]]):
                        anchor, o = p["start"] + p["off"], int(off[lo])
                        common = []
                        for w in widths:
                            low = o // w * w  # windows of the class have low <= distance < low + w
                            high = min(low + w - 1, window - 1)
                            common.append((anchor - low, anchor - high + window, o // w))
                        out.append((p["key"], p["digest"], doc, lo, common, every[p["start"] + lo : p["start"] + hi]))
                if not out:
                    continue
                a, b, c = (np.array([[x[k] for x in r[4]] for r in out]).ravel() for k in range(3))
                count = len(rolling.sums) - 1
                shared = signed(mixed(rolling.spans(np.clip(a, 0, count), np.clip(b, 0, count)) + c.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
                    + [pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(widths)), pa.array(shared)), pa.array([r[5] for r in out], pa.list_(pa.int64()))],
                    names=[*CONTENT, "doc_id", "lo", "common", "hashes"],
                )

    return both.mapInArrow(rows, "key bigint, digest bigint, doc_id bigint, lo int, common array<bigint>, hashes array<bigint>")


def repeated_windows(docs: DataFrame, window: int = 50, first: int = 13) -> DataFrame:
    """Rows doc_id, rid, spans: word intervals [lo, hi) covered by windows that start in a document with a smaller doc_id."""
    known = docs.filter("doc_id is not null")
    listed, listing = hand_over(_listed(known, window, first))
    often = listed.groupBy(F.struct("key").alias("k")).agg(F.min("doc_id").alias("key_doc"), F.max("doc_id").alias("last")).filter("key_doc < last").select("k.key", "key_doc")
    held = cut_lineage(listed.join(often, "key"))
    drop_folder(docs.sparkSession, listing)
    content = held.groupBy(*CONTENT, "key_doc").agg(
        F.min(F.struct("doc_id", "rid", "start", "run", "off", "times")).alias("first"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"),
        F.min("next").alias("next"), F.max("next").alias("next2"), F.min("times").alias("few"), F.max("times").alias("many"),
    )
    content = cut_lineage(content.select(*CONTENT, "key_doc", "first.*", "last_doc", "n", "next", "next2", "few", "many"))
    # runs that differ inside one candidate: those of later documents may hold windows of earlier ones
    several = content.groupBy(F.struct("key").alias("k")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.min("doc_id").alias("least"))
    open_ = several.filter("n > 1 and last > least").select("k.key")
    between = levels(window, first)
    candidates = cut_lineage(_extended(known, content.join(open_, "key"), window, between))
    for k in range(len(between)):
        common = F.col("common")[k]
        again = candidates.groupBy(F.struct("key", common.alias("c")).alias("k")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("k.*")
        candidates = candidates.withColumn("c", common).join(again, ["key", "c"]).drop("c")
    each = candidates.select(*CONTENT, "doc_id", F.posexplode("hashes").alias("at", "hash"), "lo")
    earliest = each.groupBy(F.struct("key", "hash").alias("k")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").select("k.*", "least")
    found = each.join(earliest, ["key", "hash"]).filter("doc_id > least").select(*CONTENT, (F.col("lo") + F.col("at")).alias("lo")).distinct()
    found = found.groupBy(*CONTENT).agg(F.collect_list("lo").alias("starts"))
    # windows of a class's least document that an earlier one has in another class; later documents lose the whole run
    partly = held.join(content.select(*CONTENT, F.col("doc_id").alias("least")).join(found, CONTENT), CONTENT).filter("doc_id = least")
    shifts = F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda j: F.col("start") + j * F.col("run"))
    single = F.flatten(F.transform(shifts, lambda at: F.transform("starts", lambda s: F.struct((at + s).alias("lo"), (at + s + window).alias("hi")))))
    end = F.col("start") + F.col("run") * F.col("times") + F.col("further") + (window - 1)
    whole = F.array(F.struct(F.col("start").alias("lo"), end.alias("hi")))
    later = held.join(stretches(content), CONTENT).filter("doc_id > least").select("doc_id", "rid", whole.alias("spans"))
    spans = later.unionByName(partly.select("doc_id", "rid", single.alias("spans")))
    return spans.groupBy("doc_id", "rid").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def stretches(content: DataFrame) -> DataFrame:
    """Classes that occur in several documents, chained: key and digest of a chain's first class, the least document, and the windows further on in the chain.

    A class is chained to the one that stands behind each of its occurrences if that one occurs as often, always repeated as many times: then neither
    occurs without the other. A chain's classes have the same first holder and are neighbours there, so only the classes of one text are ordered.
    """
    own = Window.partitionBy("doc_id", "rid").orderBy("start")
    size = F.col("run") * F.col("times")
    before = F.lag(F.struct("next", "next2", "n", (F.col("start") + size).alias("end"))).over(own)
    behind = (F.col("before.next") == F.col("digest")) & (F.col("before.next2") == F.col("digest")) & (F.col("before.n") == F.col("n")) & (F.col("before.end") == F.col("start"))
    opens = F.when(behind & (F.col("few") == F.col("many")), 0).otherwise(1)  # without a class before: no answer, so not chained
    numbered = content.filter("last_doc > doc_id").withColumn("before", before).withColumn("chain", F.sum(opens).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    chains = numbered.groupBy("doc_id", "rid", "chain").agg(F.min(F.struct("start", *CONTENT, size.alias("size"))).alias("head"), F.sum(size).alias("length"))
    return chains.select("head.key", "head.digest", F.col("doc_id").alias("least"), (F.col("length") - F.col("head.size")).cast("int").alias("further"))


def _kept(text: str | None, spans) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside ``spans``."""
    tokens = (text or "").encode().split()
    n = len(tokens)
    if spans:
        lo, hi = merged(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
        tokens = [t for a, b in zip([0, *hi.tolist()], [*lo.tolist(), n]) for t in tokens[a:b]]
    return n, tokens


def substring_dedup(docs: DataFrame, window: int = 50, first: int = 13) -> DataFrame:
    """What stays when every word covered by ``window`` consecutive words that also start in a document with a smaller doc_id is cut.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the remaining words, joined by one space) of every row of ``docs``
    (doc_id, text); ``passages_cut`` returns the texts.

    Null or empty text: no words. Texts under ``window`` words: whole. A null doc_id is neither smaller nor larger than another one: the
    row is kept whole and is no source. Rows that repeat a doc_id don't remove from one another. Empty table: no rows.
    Other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash().alias("rid"), "text")
    both = slim.join(repeated_windows(slim, window, first), ["doc_id", "rid"], "left")

    def cut(batches):
        for batch in batches:
            n, removed, digests = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                count, tokens = _kept(text, spans)
                n.append(count)
                removed.append(count - len(tokens))
                digests.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return both.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def passages_cut(docs: DataFrame, window: int = 50, first: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated passages cut from ``text``; a column ``n_chars`` follows it.

    A text without any stays as it is; a cut one has its remaining words joined by one space. A row of which no word is left goes.
    """
    mark = free_prefix(docs.columns)
    rid, doc, row, found, changed = (mark + c for c in ("rid", "doc", "row", "spans", "cut"))
    own = docs.withColumn(rid, row_hash())
    slim = own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(rid).alias("rid"), "text")
    spans = repeated_windows(slim, window, first).select(F.col("doc_id").alias(doc), F.col("rid").alias(row), F.col("spans").alias(found))
    both = own.join(spans, (own["doc_id"] == spans[doc]) & (own[rid] == spans[row]), "left")
    both = both.select(*(f"`{c}`" for c in docs.columns), found)
    types = dict(docs.dtypes)

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column(found).to_pylist()):
                if spans:
                    texts[i] = b" ".join(_kept(texts[i], spans)[1]).decode()
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in docs_columns]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([s is not None for s in batch.column(found).to_pylist()], pa.bool_())], names=[*docs_columns, changed])

    docs_columns = docs.columns
    out = both.mapInArrow(cut, ", ".join([*(f"`{c}` {types[c]}" for c in docs_columns), f"{changed} boolean"])).filter(f"not {changed} or text <> ''").drop(changed)
    return out.withColumn("n_chars", F.length("text").cast(types["n_chars"])) if "n_chars" in types else out
