"""Fill-in-middle against a plain re-computation on code points, and its inverse."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotweave.llm import fim
from tests.llm.helpers import docs, odd_rows

MARKS = (b"<P>", b"<S>", b"<M>")


def plain(doc, text, seed=1, plain_percent=10, spm_percent=20):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain_percent:
        return doc, len(tokens), "plain", None, None, text
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, len(tokens), form, len(prefix), len(middle), out


def rows():
    tricky = ["<", "<P", "P>", "<<S>", "a<M>b", "<P<S", "\x00\n\r", "é", "Aé日b𝄞c", "<p>", "S><", "a" * 70000 + "-" + "b" * 70000, "日" * 50000]
    return odd_rows() + [(100 + i, t) for i, t in enumerate(tricky * 4)]


@pytest.mark.parametrize("seed, plain_percent, spm_percent", [(1, 10, 20), (7, 0, 50), (1, 100, 20), (2, 0, 100)])
def test_forms(spark, seed, plain_percent, spm_percent):
    made = fim.fill_in_middle(docs(spark, rows()), seed, plain_percent, spm_percent)
    want = sorted((plain(d, t, seed, plain_percent, spm_percent) for d, t in rows()), key=repr)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == want
    back = fim.restored(made)
    assert back.columns == [*made.columns, "text"]
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t in rows()), key=repr)


def test_edges(spark):
    assert fim.fill_in_middle(docs(spark, rows()).filter("false")).count() == 0
    made = spark.createDataFrame([(1, None, "psm", "old"), (2, "<P>a<S>c<M>b", None, "old"), (3, "<P>a<S>c<M>b", "psm", "old"), (4, "<S>c<P>a<M>b", "spm", "old")], "doc_id bigint, output string, form string, text string")
    assert [r["text"] for r in fim.restored(made).orderBy("doc_id").collect()] == [None, None, "abc", "abc"]
    with pytest.raises(Exception, match="subsection not found|substring not found|not found"):
        fim.restored(spark.createDataFrame([("x", "psm")], "output string, form string")).collect()
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs(spark, []), sentinels=("<P>", "<P>", "<M>"))
    other = ("⟨p⟩", "<|suffix|>", "[M]")
    again = fim.restored(fim.fill_in_middle(docs(spark, rows()), plain_percent=0, sentinels=other), other)
    assert sorted(((r["doc_id"], r["text"]) for r in again.collect()), key=repr) == sorted(((d, t or "") for d, t in rows()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from([1, 3, 1 << 16]))
def test_rotations(raw, a, b, swap):
    old, fim.SWAP = fim.SWAP, swap
    try:
        a, b = sorted((min(a, len(raw)), min(b, len(raw))))
        buffer = bytearray(raw)
        fim.rotate(buffer, a, b, len(raw))
        assert bytes(buffer) == raw[:a] + raw[b:] + raw[a:b]
        fim.rotate(buffer, a, a + len(raw) - b, len(raw))
        assert bytes(buffer) == raw
        if not any(m in raw for m in MARKS):
            for form in ("psm", "spm"):
                out = fim.transformed(raw, a, b, form, MARKS)
                assert len(out) == len(raw) + 9 and bytes(fim.inverted(bytes(out), form, MARKS)) == raw
    finally:
        fim.SWAP = old


def test_tokens_end_with_their_text():
    texts = ["ab", "cd", "", "é日x", "1a", ""]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    place, first = fim.token_starts(np.frombuffer(b"".join(raw), np.uint8), at)
    assert np.diff(first).tolist() == [len(re.findall("[A-Za-z]+|[^A-Za-z]", t)) for t in texts]


def test_long_text(spark):
    r = random.Random(3)
    text = "".join(r.choice(["word ", "日", "\n", "Long", "x1"]) for _ in range(2_000_000))
    made = fim.fill_in_middle(docs(spark, [(5, text)]), plain_percent=0)
    assert tuple(made.first()) == plain(5, text, plain_percent=0)
    assert fim.restored(made).first()["text"] == text
