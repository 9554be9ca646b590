"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once, so that tokens are what training would see; the tokens' byte spans are then joined to the spans of sections
by searching sorted bounds, and a token that crosses a bound is allocated by a rule:

    start     all of it to the section its first byte is in
    end       all of it to the section its last byte is in
    majority  all of it to the section with most of its bytes, the earlier one of equals
    split     to each section by its share of the bytes

Sums over sections equal the document's token count under every rule.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.common import chunks, flat

#: Fixed values of the public byte-level vocabulary: how it cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "majority", "split")
_STOPS = np.frombuffer(b".!?", np.uint8)
_ENCODERS: dict[str, tuple] = {}


def read_ranks(path: str) -> bytes:
    """A vocabulary file, read by the driver. It holds a fixed number of tokens, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str = PATTERN):
    """Encoding and byte length of each token; kept for the life of the process."""
    key = hashlib.sha1(ranks).hexdigest() + pattern
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            sizes[rank] = len(token)
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes
    return _ENCODERS[key]


def token_ends(text: str, encoding, sizes: np.ndarray) -> np.ndarray:
    """Byte offset of each token's end. Text that looks like a special token is ordinary text."""
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    return np.cumsum(sizes[ids])


def sections(raw: np.ndarray) -> np.ndarray:
    """Bounds of the sections of UTF-8 text: sentences, each with the one space or line end after it; a line end always ends one.

    The empty text has one empty section.
    """
    close = raw == 10
    close[1:] |= (raw[1:] == 32) & np.isin(raw[:-1], _STOPS)
    ends = np.flatnonzero(close) + 1
    bounds = np.concatenate([[0], ends, [len(raw)] if not len(ends) or ends[-1] < len(raw) else []])
    return bounds.astype(np.int64)


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [bounds[i], bounds[i + 1]); tokens and sections both cover the text without gaps."""
    n = len(bounds) - 1
    if not len(ends):
        return np.zeros(n)
    starts = np.concatenate([[0], ends[:-1]])
    low = np.searchsorted(bounds, starts, "right") - 1
    high = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "start":
        return np.bincount(low, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(high, minlength=n).astype(float)
    whole = low == high
    out = np.bincount(low[whole], minlength=n).astype(float)
    two = high == low + 1  # nearly all that cross: in two sections
    first = bounds[high[two]] - starts[two]
    size = ends[two] - starts[two]
    if rule == "majority":
        out += np.bincount(np.where(2 * first >= size, low[two], high[two]), minlength=n)
    else:
        out += np.bincount(low[two], first / size, n) + np.bincount(high[two], 1 - first / size, n)
    for a, b, i, j in zip(*(x[~whole & ~two].tolist() for x in (starts, ends, low, high))):
        parts = [min(b, int(bounds[k + 1])) - max(a, int(bounds[k])) for k in range(i, j + 1)]
        if rule == "majority":
            out[i + int(np.argmax(parts))] += 1
        else:
            out[i : j + 1] += np.array(parts) / (b - a)
    return out


def section_tokens(docs: DataFrame, vocabulary: str, rule: str = "start", pattern: str = PATTERN) -> DataFrame:
    """Token counts of every section of every row of ``docs`` (doc_id, text); sections are sentences.

    Returns doc_id, n_tokens, n_sections, n_crossing (tokens in more than one section) and sections: an array of begin, end (bytes) and tokens.

    ``vocabulary`` is the path of a file of ranks; the driver reads it and broadcasts it, as its size is that of the vocabulary.

    Null or empty text: one empty section, no tokens. Null or repeated doc_id: each row by itself. Empty table: no rows. Other columns are
    not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    spark: SparkSession = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    schema = "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, sections array<struct<begin:bigint,end:bigint,tokens:double>>"

    def counted(batches):
        encoding, sizes = encoder(ranks.value, pattern)
        for batch in batches:
            data, at = flat(batch.column("text"))
            for i, j in chunks(at, 1 << 22):
                rows, begin, end, tokens = [], [], [], []
                for d in range(i, j):
                    raw = data[at[d] : at[d + 1]]
                    ends = token_ends(raw.tobytes().decode(), encoding, sizes)
                    bounds = sections(raw)
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    crossing = int((np.searchsorted(bounds, starts, "right") != np.searchsorted(bounds, ends - 1, "right")).sum())
                    rows.append((len(ends), len(bounds) - 1, crossing))
                    begin.append(bounds[:-1])
                    end.append(bounds[1:])
                    tokens.append(allocate(ends, bounds, rule))
                counts = np.array(rows, np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum(counts[:, 1])]).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (begin, end, tokens)], names=["begin", "end", "tokens"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *(pa.array(counts[:, k]) for k in range(3)), pa.ListArray.from_arrays(pa.array(offsets), parts)],
                    names=["doc_id", "n_tokens", "n_sections", "n_crossing", "sections"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(counted, schema)
