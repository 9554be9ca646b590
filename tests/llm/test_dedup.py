"""Suffix-array dedup, substring dedup and SimHash against plain re-computation."""

import collections
import hashlib
import re
import sys

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from slotweave.llm import induced, mixing, quality, simhash, substring, suffix_dedup
from slotweave.llm.common import anchored_runs, merged
from slotweave.llm.plans import QUERIES
from tests.llm.helpers import SPACES, docs, lower, odd_rows, prose


def cut_bytes(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


def cut_words(rows, window):
    first, out = {}, []
    tokens = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in tokens:
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, w in tokens:
        mark = [0] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                mark[i : i + window] = [1] * window
        kept = b" ".join(x for x, m in zip(w, mark) if not m)
        out.append((d, len(w), sum(mark), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_prefixes(symbols):
    s = np.array([*symbols, 0])
    array = induced.suffix_array(s)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert array.tolist() == want
    before, shared = induced.common_prefixes(s, array)
    for a, b in zip(want, want[1:]):
        n = next(k for k in range(len(s)) if s[a + k] != s[b + k])
        assert (before[b], shared[b]) == (a, n)


def test_suffix_array_of_long_and_even_texts():
    r = np.random.default_rng(2)
    for s in (r.integers(1, 200, 50_000), np.full(5000, 7), np.tile([3, 1, 2], 4000), np.arange(3000, 0, -1), np.arange(1, 3000)):
        s = np.append(s, 0)
        array = induced.suffix_array(s)
        place = np.empty(len(s), np.int64)
        place[array] = np.arange(len(s))
        behind = np.append(place[1:], -1)  # suffixes are in order if symbols are, and of equal ones the places of the suffixes behind
        keys = np.stack([s[array], behind[array]], 1)
        assert sorted(array.tolist()) == list(range(len(s))) and (np.lexsort((keys[:, 1], keys[:, 0])) == np.arange(len(s))).all()


@pytest.mark.parametrize("stretch", [1, 5, 128, 1 << 30])
def test_induced_by_stretches_or_by_the_loop(monkeypatch, stretch):
    """Stretches of one place and none at all give the same order: of prose, runs, periods, and more symbols than short numbers have."""
    monkeypatch.setattr(induced, "STRETCH", stretch)
    r = np.random.default_rng(3)
    text = np.frombuffer((prose(150, 1) * 2 + prose(80, 2)).encode(), np.uint8).astype(np.int64) + 2
    for s in (text, np.repeat(r.integers(1, 9, 30), r.integers(1, 60, 30)), np.full(1500, 4), np.tile([2, 1], 700), r.integers(1, 3, 1500), r.permutation(np.arange(1, 1500)) * 30):
        s = np.append(s, 0)
        raw = s.astype(">i4").tobytes()
        assert induced.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: raw[4 * i :])


def test_induction_of_prose_takes_few_python_steps():
    """The walks deal out whole stretches: fewer lines of Python are run than the text has symbols."""
    s = np.append(np.random.default_rng(4).choice(np.frombuffer(prose(3000, 6).encode(), np.uint8), 60_000).astype(np.int64) + 1, 0)
    lines = 0

    def traced(frame, event, arg):
        nonlocal lines
        if frame.f_code.co_filename != induced.__file__:
            return None
        lines += event == "line"
        return traced

    before = sys.gettrace()
    sys.settrace(traced)
    try:
        up = induced._ascending(s)
        lms = np.flatnonzero(np.append(False, up[1:] & ~up[:-1]))
        induced._induce(s, up, lms, np.concatenate([[0], np.cumsum(np.bincount(s))]))
    finally:
        sys.settrace(before)
    assert 0 < lines < len(s)


def test_equal_windows_have_equal_anchors():
    grams = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    twice = np.concatenate([grams[:200], grams[:200]])
    item, start, run, anchor = anchored_runs(twice, np.array([0, 200, 400]), 40, 10)
    one = [(s, r, a) for i, s, r, a in zip(item, start, run, anchor) if i == 0]
    assert one == [(s - 200, r, a - 200) for i, s, r, a in zip(item, start, run, anchor) if i == 1]
    assert sum(r for _, r, _ in one) == 161 and all(s <= a <= s + 30 for s, _, a in one)


def test_merged():
    assert [x.tolist() for x in merged(np.array([5, 0, 2, 9]), np.array([7, 3, 5, 10]))] == [[0, 9], [7, 10]]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_suffix_dedup_odd_rows(spark, shard_bytes):
    rows = odd_rows()
    want = cut_bytes([(t or "").encode() for _, t in rows], 40)
    got = suffix_dedup.suffix_dedup(docs(spark, rows), length=40, gram=12, shard_bytes=shard_bytes)
    same(got.drop("kept"), [(d, *w) for (d, _), w in zip(rows, want)])
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.suffix_dedup(docs(spark, [(1, "a")]).filter("false")).count() == 0
    parts = [prose(40, 8), prose(40, 9)]
    rows = [(i, prose(20, 100 + i) + parts[i % 2] + prose(20, 200 + i)) for i in range(40)] + [(99, parts[0] + parts[1] + parts[0])]
    want = cut_bytes([t.encode() for _, t in rows], 60)
    for shard_bytes in (1 << 20, 2000):  # one shard; groups too large for one
        got = suffix_dedup.suffix_dedup(docs(spark, rows), length=60, gram=20, shard_bytes=shard_bytes, keep_text=False)
        same(got, [(d, *w) for (d, _), w in zip(rows, want)])


def test_suffix_dedup_tells_planted_passages_by_what_it_removes(spark):
    """Every holder of a passage of 400 bytes has them removed; one byte less, and clean documents, stay whole."""
    long, short = prose(200, 70)[:400], prose(200, 71)[:399]
    assert len(long.encode()) == 400 and len(long.split()) > 50 and len(short.split()) > 50
    planted = {i: long if i % 3 == 0 else short if i % 3 == 1 else "" for i in range(60)}
    rows = [(i, prose(60, 1000 + i) + chr(33 + i) + p + chr(33 + i) + prose(60, 2000 + i)) for i, p in planted.items()]  # no two go on alike
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(docs(spark, rows), length=400, keep_text=False).collect()}
    assert got == {i: 400 if p == long else 0 for i, p in planted.items()}


@pytest.mark.parametrize("size", [50, 700, 5000])
def test_suffix_dedup_long_text_in_pieces(spark, size):
    """Texts over ``size`` bytes are listed by overlapping pieces: every window once, marks where they belong."""
    a = prose(400, 3).encode()
    at = list(suffix_dedup._stretches(np.array([0, len(a)]), 39, size))
    assert sum(len(range(o[-1] - 39)) for _, _, o, _ in at) == len(a) - 39
    part = prose(60, 5)
    rows = [(1, prose(900, 1) + part + prose(500, 2)), (2, prose(30, 7)), (3, part[40:300] + prose(600, 4) + part), (4, "ab" * 3000), (5, prose(300, 8) * 2)]
    got = suffix_dedup.suffix_dedup(docs(spark, rows), length=40, gram=12, keep_text=False, size=size)
    same(got, [(d, *w) for (d, _), w in zip(rows, cut_bytes([t.encode() for _, t in rows], 40))])


def test_suffix_dedup_grams_of_any_length(spark):
    """Texts of few different grams: shards would grow, so longer grams take over, up to whole windows."""
    r = np.random.default_rng(6)
    rows = [(i, "".join(r.choice(["aaaaaaaa", "b" * 20, "ab" * 9], 60))) for i in range(30)] + [(50, "a" * 900), (51, "a" * 700 + "b"), (52, "ab" * 400)]
    want = [(d, *w) for (d, _), w in zip(rows, cut_bytes([t.encode() for _, t in rows], 60))]
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)
    for shard_bytes in (1 << 20, 500, 1):
        same(suffix_dedup.suffix_dedup(docs(spark, rows), length=60, gram=8, shard_bytes=shard_bytes, keep_text=False), want)
    assert [suffix_dedup.longer(g, 60) for g in (8, 34, 58, 59)] == [34, 47, 59, 60]


@pytest.mark.parametrize("first", [3, 7, 20])
def test_substring_dedup_odd_rows(spark, first):
    rows = odd_rows()
    same(substring.substring_dedup(docs(spark, rows), window=20, first=first), cut_words(rows, 20))


def test_substring_dedup_edges(spark):
    assert substring.substring_dedup(docs(spark, [(1, "a")]).filter("false")).count() == 0
    assert substring.levels(50, 13) == [26] and substring.levels(50, 25) == [] and substring.levels(100, 10) == [20, 40, 80]
    passage = prose(70, 5)
    rows = [(i, prose(10 + i, 50 + i) + " " + passage + " " + prose(5, 90 + i)) for i in range(30)]
    same(substring.substring_dedup(docs(spark, rows)), cut_words(rows, 50))
    table = docs(spark, [*rows, (77, "a  b\n"), (78, passage), (None, passage)])
    cut = {r["doc_id"]: r for r in substring.passages_cut(table).collect()}
    assert cut[0]["text"] == rows[0][1] and cut[77]["text"] == "a  b\n" and 78 not in cut and cut[None]["text"] == passage
    assert cut[9]["text"] == rows[9][1].replace(passage + " ", "") and cut[9]["n_chars"] == len(cut[9]["text"]) and cut[9]["spans"] == "?"


@pytest.mark.parametrize("window", [60, 100, 200])
def test_substring_dedup_several_levels(spark, window):
    """Passages little longer than the window, between contexts that differ."""
    rows = []
    for k in range(12):
        passage = prose(window + 20, 1000 + k)
        for i in range(3):
            rows.append((10 * k + i, f"{prose(7 * k + 31 * i + 3, 2000 + 10 * k + i)} {passage} {prose(90 + i, 3000 + 10 * k + i)}"))
    same(substring.substring_dedup(docs(spark, rows), window=window), cut_words(rows, window))


def plain_fingerprint(text):
    w = re.findall(SPACES, lower(text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, radius):
    low = list(range(len(fps)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                low[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_odd_rows(spark):
    rows = odd_rows() + [(20 + i, prose(400, 7) + f" {i}") for i in range(12)] + [(40, prose(2, 9)), (41, "A B"), (42, "a b")]
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components(fps, [d for d, _ in rows], 3)
    same(simhash.simhash_near_duplicates(docs(spark, rows)), [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comps)])
    assert simhash.simhash_near_duplicates(docs(spark, [(1, "a")]).filter("false")).count() == 0


def test_simhash_one_of_each(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "q r s t u v"), (None, None), (None, ""), (5, None), (None, "n u l l only")]
    got = simhash.one_of_each(docs(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, "a b c d"), (2, "q r s t u v"), (5, None), (None, "n u l l only")], key=repr)
    assert got.columns == docs(spark, rows).columns


def test_tiles_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # tiles in several blocks
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), False)) for c in centres for _ in range(6)]
    fps = sorted({*map(int, centres), *near, 0, 1, (1 << 64) - 1})
    table = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp bigint")
    found = simhash.components(simhash.links(table, 3)).collect()
    want = plain_components(fps, fps, 3)
    group = {int(np.array(x["node"], np.int64).view(np.uint64)): x["root"] for x in found}
    assert len({w for w in want}) == len(fps) - len(group) + 0 * len(want)
    roots = collections.defaultdict(set)
    for f, w in zip(fps, want):
        roots[w].add(group.get(f, int(np.array(f, np.uint64).view(np.int64))))
    assert all(len(v) == 1 for v in roots.values()) and len({next(iter(v)) for v in roots.values()}) == len(roots)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (502, 501)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 501: 500, 502: 500}


def test_registered_queries(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = cut_bytes([(t or "").encode() for _, t in rows], 400)
    got = QUERIES["op1_suffix_array_dedup"](spark, sf_dir)
    same(got.drop("text"), [(d, *w) for (d, _), w in zip(rows, want)])
    whole = [r for r in got.collect() if "\ufffd" not in r["text"]]
    assert len(whole) > len(rows) / 2 and all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in whole)
    same(QUERIES["op10_substring_dedup"](spark, sf_dir), cut_words(rows, 50))
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components(fps, [d for d, _ in rows], 3)
    same(QUERIES["op9_simhash_near_dedup"](spark, sf_dir), [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comps)])


def test_stages_keep_any_columns(spark):
    """Helper columns have names that no column of the table has."""
    names = ["_rid", "_again", "_x", "_score", "_draw", "__rid", "_spans", "spans", "rid", "copy"]
    base = prose(300, 1)
    rows = [(i, t, "en", "s", len(t or ""), *(f"{n}{i}" for n in names)) for i, t in [(1, base), (2, base), (3, prose(80, 2)), (3, prose(80, 2)), (4, None), (None, "x y")]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, quality int")
    before = {tuple(r) for r in table.collect()}
    for made in (simhash.one_of_each(table), substring.passages_cut(table), quality.accepted(table, labels, threshold=0.0)):
        assert made.columns == table.columns
        got = [tuple(r) for r in made.collect()]
        assert {r[:2] + r[5:] for r in got} <= {r[:2] + r[5:] for r in before} and got
    mixed = mixing.soft_mixing(table, labels.selectExpr("doc_id", "if(quality = 1, 'a', 'b') as domain"), {"a": 0.5, "b": 0.5}, extra=tuple(table.columns))
    assert {tuple(r)[1 : len(table.columns)] for r in mixed.select("doc_id", *[c for c in table.columns if c != "doc_id"]).collect()} == {r[1:] for r in before}


@pytest.mark.parametrize("window", [50, 60, 120])
def test_long_passages_are_stretches(spark, window):
    """Passages of many runs in many contexts, nested, overlapping and doubled in one document."""
    long, other = prose(700, 1).split(), prose(400, 2).split()
    parts = [long, long[100:600], long[300:] + other, other[:200] + long[:350], other, long[:260] + other[100:], long + long[50:400]]
    rows = [(i, prose(30 + i, 100 + i) + " " + " ".join(parts[i % len(parts)]) + " " + prose(20 + i, 200 + i)) for i in range(40)]
    rows += [(5, rows[3][1]), (None, rows[0][1])]
    same(substring.substring_dedup(docs(spark, rows), window), cut_words(rows, window))


def test_a_passage_is_one_stretch(spark, monkeypatch):
    """About 30 runs that stand in 50 documents are joined to their holders as one row."""
    made, plain = [], substring.stretches
    monkeypatch.setattr(substring, "stretches", lambda content: made.append(plain(content)) or made[0])
    passage = prose(600, 1)
    rows = [(i, f"{prose(40, 10 + i)} {passage} {prose(40, 900 + i)}") for i in range(50)]
    same(substring.substring_dedup(docs(spark, rows)), cut_words(rows, 50))
    assert [(r["least"], r["further"] > 400) for r in made[0].collect()] == [(0, True)]


def test_periodic_passages(spark):
    """Words that repeat with any period, as often here and there, alone and between other text."""
    unit = {1: "ha", 2: "ha ho", 3: "a b c", 7: prose(7, 1), 30: prose(30, 2), 75: prose(75, 3)}
    texts = [f"{prose(5 + k % 3, 50 + k)} {' '.join([unit[p]] * n)} {prose(6, 80 + k)}" for k, (p, n) in enumerate((p, n) for p in unit for n in (-(-49 // p), -(-51 // p), 90 // p + 2, 400 // p + 1, 400 // p + 1))]
    rows = [*enumerate(texts), (200, texts[3] + " " + texts[9]), (201, " ".join(["ha"] * 300 + ["ho"] * 300)), (202, " ".join(["ho"] * 200 + ["ha"] * 100))]
    same(substring.substring_dedup(docs(spark, rows)), cut_words(rows, 50))
    same(substring.substring_dedup(docs(spark, rows), 120), cut_words(rows, 120))


def test_a_repeated_run_is_one_row(spark):
    text = "x y " * 500
    listed = substring._listed(docs(spark, [(1, text), (2, text)]).select("doc_id", substring.row_hash().alias("rid"), "text"), 50, 13)
    assert listed.count() < 10 and listed.agg({"times": "max"}).first()[0] > 400


def test_dense_tiles_are_dealt_by_block(spark, monkeypatch):
    """Fingerprints of one tile in many blocks: every pair of blocks is compared, and once."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    r = np.random.default_rng(3)
    fps = {int(sum(1 << int(b) for w in range(4) for b in 16 * w + r.choice(16, 8, replace=False))) for _ in range(60)}
    fps |= {f ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for f in list(fps)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 3).collect()]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    assert len(got) > 40

    def classes(edges):
        root = {x: x for x in signed}
        for _ in range(len(signed)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(got) == classes([(a, b) for i, a in enumerate(signed) for b in signed[:i] if near(a, b)])
