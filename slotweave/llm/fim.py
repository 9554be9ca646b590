"""Fill-in-middle transformation by block rotation in place, and its exact inverse.

A text's tokens are scanned for two cuts. Sentinels are inserted into one bytearray as ``<P>prefix<M>middle<S>suffix``; two neighbouring
segments then change places by a rotation of three reversals, each of which swaps bytes from both ends with a small fixed
buffer. The inverse finds the sentinels, rotates back and deletes them. Rows stay where they are: nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import chunks, flat

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes swapped at once by a reversal.
SWAP = 1 << 16
_CODES = np.arange(256)
_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122))
_LEAD = (_CODES & 0xC0) != 0x80


def token_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` of some texts begin, and the first token of each text."""
    letter = _LETTER[data]
    starts = _LEAD[data]
    inside = letter[1:] & letter[:-1]
    inside[at[(at > 0) & (at < len(data))] - 1] = False  # a run of letters ends with its text
    starts[1:] &= ~inside
    place = np.flatnonzero(starts)
    return place, np.searchsorted(place, at)


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Turn ``view[lo:hi]`` round in place."""
    while hi - lo > 1:
        n = min(SWAP, (hi - lo) // 2)
        left = view[lo : lo + n].copy()
        view[lo : lo + n] = view[hi - n : hi][::-1]
        view[hi - n : hi] = left[::-1]
        lo, hi = lo + n, hi - n


def rotate(buffer: bytearray, lo: int, middle: int, hi: int) -> None:
    """Let the segments [lo, middle) and [middle, hi) change places; ``rotate(buffer, lo, lo + hi - middle, hi)`` undoes it."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, lo, middle)
    reverse(view, middle, hi)
    reverse(view, lo, hi)


def transformed(raw: bytes, a: int, b: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text in ``form`` (psm or spm) with its middle at bytes [a, b)."""
    p, s, m = marks
    out = bytearray(raw)
    out[b:b] = s
    out[a:a] = m
    out[0:0] = p
    rotate(out, len(p) + a if form == "psm" else 0, len(p) + len(m) + b, len(out))
    return out


def inverted(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text that ``transformed`` was given."""
    p, s, m = marks
    out, end = bytearray(output), len(output)
    lo, middle = (out.index(s), out.index(m)) if form == "psm" else (0, out.index(p))
    rotate(out, lo, middle, end)  # <P>prefix<M>middle<S>suffix
    at_s = end - (middle - lo)
    at_m = lo if form == "psm" else out.index(m)
    del out[at_s : at_s + len(s)]
    del out[at_m : at_m + len(m)]
    del out[: len(p)]
    return out


def _marks(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    marks = tuple(x.encode() for x in sentinels)
    for x in marks:
        for y in marks:
            overlap = any(x[-n:] == y[:n] for n in range(1, min(len(x), len(y)) + (x is not y)))
            if not x or overlap or (x is not y and x in y):
                raise ValueError(f"sentinels must be different and not overlap: {sentinels}")  # else the inverse could find a false one
    return marks


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n (tokens), form, prefix_chars, middle_chars (code points) and output.

    h1 to h4 are the first four 8-digit groups of the SHA-256 of ``<seed>:<doc_id>``. The prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) tokens, the middle after the larger. ``plain_percent`` of the rows by h3 stay as they are, ``spm_percent`` of the others
    by h4 have the suffix first.

    Empty text, or one that contains a sentinel: form plain, output is the text. Null text: as empty. A null doc_id draws as an empty id.
    Repeated rows get equal results. Empty table: no rows. Other columns are not read. A text of any length is one row
    of work: it, its output and a mark per byte are in memory.
    """
    marks = _marks(sentinels)

    def rows(batches):
        for batch in batches:
            ids, (data, at) = batch.column("doc_id").to_pylist(), flat(batch.column("text"))
            n, form, prefix, middle, out = [], [], [], [], []
            for i, j in chunks(at):
                piece, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                place, first = token_starts(piece, own)
                for k in range(j - i):
                    tokens, text = place[first[k] : first[k + 1]] - own[k], piece[own[k] : own[k + 1]]
                    raw, doc = text.tobytes(), ids[i + k]
                    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
                    h1, h2, h3, h4 = (int(h[8 * x : 8 * x + 8], 16) for x in range(4))
                    n.append(len(tokens))
                    if not raw or h3 % 100 >= 100 - plain_percent or any(x in raw for x in marks):
                        form.append("plain"), prefix.append(None), middle.append(None), out.append(raw)
                        continue
                    ends = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
                    a, b = (int(tokens[e]) if e < len(tokens) else len(raw) for e in ends)
                    form.append("spm" if h4 % 100 < spm_percent else "psm")
                    prefix.append(int(np.count_nonzero(_LEAD[text[:a]])))
                    middle.append(int(np.count_nonzero(_LEAD[text[a:b]])))
                    out.append(bytes(transformed(raw, a, b, form[-1], marks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(rows, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``text``, rebuilt from output and form alone, as last column.

    A null output or form: null text. An output without its sentinels raises. A text column of ``made`` is replaced.
    """
    marks = _marks(sentinels)
    names = [c for c in made.columns if c != "text"]

    def rows(batches):
        for batch in batches:
            back = []
            for output, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist()):
                known = output is not None and form is not None
                back.append((bytes(inverted(output.encode(), form, marks)) if form != "plain" else output.encode()) if known else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(back, pa.binary()).cast(pa.string())], names=[*names, "text"])

    types = dict(made.dtypes)
    return made.select(*(f"`{c}`" for c in names)).mapInArrow(rows, ", ".join([*(f"`{c}` {types[c]}" for c in names), "text string"]))
