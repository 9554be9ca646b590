"""Spelling variants against a plain re-computation."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from slotweave.llm import variants
from slotweave.llm.plans import QUERIES
from tests.llm.helpers import docs, lower, odd_rows


def plain(rows, least_length=7, least_count=2, factor=10, every=31):
    seen = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= least_length and k >= least_count}
    near = collections.defaultdict(set)
    without = collections.defaultdict(set)  # words by what is left without one letter
    for w in n:
        for i in range(len(w)):
            without[w[:i], w[i + 1 :]].add(w)
    for (a, b), ws in without.items():
        for w in ws:
            near[w] |= ws - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    forms = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            forms[w] = best

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted(((w, forms.get(w), root(w), n[w], len(near[w]), n[forms[w]] if w in forms else None) for w in n), key=repr)


def same(df, want):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def misspelt(seed, words=60, texts=80, letters="abcdéÿ"):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(5, 14))) for _ in range(words)]
    out = []
    for d in range(texts):
        picked = []
        for _ in range(120):
            w = stems[min(int(r.expovariate(0.08)), words - 1)]
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                k, kind = r.randrange(len(w)), r.randrange(3)
                w = w[:k] + (r.choice(letters) if kind else "") + w[k + (kind != 2) :]
            picked.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        out.append((d, r.choice([" ", "-", "1"]).join(picked)))
    return out


@pytest.mark.parametrize("part, pack", [(2048, 256), (8, 16), (2048, 1)])
def test_variants(spark, monkeypatch, part, pack):
    monkeypatch.setattr(variants, "PART", part)
    monkeypatch.setattr(variants, "PACK", pack)
    rows = misspelt(part) + [(None, "chained " * 500 + "chaineds " * 50 + "chainedss " * 5 + "chainédss " * 5), (None, None)]
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 100 and any(r[2] not in (r[0], r[1]) for r in want)
    same(variants.spelling_variants(docs(spark, rows)), want)


def test_odd_rows(spark):
    rows = odd_rows() + [(30, "×÷×÷×÷×÷ ŁaaaaaaaŁ bbbbbbbbācccccccc DDDDDDD\nddddddd"), (30, "×÷×÷×÷×÷ ×÷×÷×÷×÷÷"), (31, "q" * 3000 + " " + "q" * 2999 + "r"), (32, "q" * 3000 + " " + "q" * 2999 + "r " + "q" * 2999)]
    same(variants.spelling_variants(docs(spark, rows + rows)), plain(rows + rows))
    same(variants.spelling_variants(docs(spark, rows), 1, 1, 2, 5), plain(rows, 1, 1, 2, 5))
    assert variants.spelling_variants(docs(spark, rows).filter("false")).count() == 0
    assert variants.spelling_variants(docs(spark, [(1, None), (2, ""), (3, "short words twice short words twice")])).count() == 0


def test_long_words_in_split_blocks(spark, monkeypatch):
    """Blocks whose parts hold a word each, compared in pairs."""
    monkeypatch.setattr(variants, "LETTERS", 64)
    monkeypatch.setattr(variants, "PART", 4)
    rows = misspelt(4, words=10, texts=20)
    same(variants.spelling_variants(docs(spark, rows)), plain(rows))


def test_edits():
    words = ["abcdefg", "abcdefgh", "zabcdefg", "abcxdefg", "abcdefx", "abcdegf", "aabcdefg", "abcdefgg", "bacdefg", "abcdef"]
    letters = variants._letters([w.encode("latin-1") for w in words])
    size = np.array([len(w) for w in words])
    zero = np.zeros(len(words), int)
    at = variants.edited_at(letters[zero], letters, size[zero], size)
    assert at.tolist() == [-1, 7, 0, 3, 6, -1, 1, 7, -1, -1]
    counts = variants._counts(letters)
    assert ((counts[0] - counts) ** 2).sum(1).tolist() == [0, 1, 1, 1, 2, 0, 1, 1, 0, 1]


def test_counts_over_many_batches(spark, monkeypatch):
    rows = misspelt(5)
    whole = sorted(map(tuple, variants.vocabulary(docs(spark, rows)).collect()))
    monkeypatch.setattr(variants, "HELD", 3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(tuple, variants.vocabulary(docs(spark, rows)).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_registered_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(QUERIES["op13_spelling_variants"](spark, sf_dir), plain(rows))


def test_very_long_words(spark):
    rows = [(31, "q" * 300_000 + " " + "q" * 299_999 + "r"), (32, "q" * 300_000 + " " + "q" * 299_999 + "r " + "q" * 299_999)]
    got = {r["word"]: r["n_near"] for r in variants.spelling_variants(docs(spark, rows * 2), every=1 << 40).collect()}
    assert got == {"q" * 300_000: 2, "q" * 299_999 + "r": 2, "q" * 299_999: 2}
