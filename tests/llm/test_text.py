"""Quality, decontamination, fingerprints, tokens and mixing."""

import bisect
import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest

from slotweave.llm import decontam, merkle, mixing, quality, tokens
from slotweave.llm.plans import QUERIES, VOCABULARY
from tests.llm.helpers import docs, lower, odd_rows, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_hits(rows, items, window=13):
    places = collections.defaultdict(set)
    for name, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            places[tuple(w[i : i + n])].add("" if name is None else str(name))
    out = []
    for d, text in rows:
        w = WORD.findall(lower(text))
        mark, found = [0] * len(w), set()
        for n in {len(k) for k in places}:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                if k in places:
                    mark[i : i + n] = [1] * n
                    found |= places[k]
        out.append((d, len(w), sum(mark), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(mark) > 0 and 20 * sum(mark) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes, held", [(1 << 24, 1 << 26), (200, 1 << 26), (200, 300)])
def test_decontamination(spark, monkeypatch, block_bytes, held):
    monkeypatch.setattr(decontam, "HELD", held)
    rows = odd_rows() + [(50, "Déjà-VU, " + prose(13, 1).upper() + "?"), (51, prose(700, 33) + " " + prose(20, 1)), (52, "x one two y"), (53, "one two"), (54, prose(13, 1)), (55, "aa bb " * 40)]
    items = [(1, prose(40, 1)), (1, prose(14, 2)), (2, "ONE two"), (3, None), (None, "日本語 " * 3), (4, ""), (5, prose(20, 1)), (6, "aa bb " * 8)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.find_contamination(docs(spark, rows), bench, block_bytes=block_bytes)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == plain_hits(rows, items)
    kept = decontam.uncontaminated(docs(spark, rows), bench, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in kept.select("doc_id", "text").collect()), key=repr) == sorted((r for r, w in zip(sorted(rows, key=repr), [plain_hits([r], items)[0] for r in sorted(rows, key=repr)]) if not w[-1]), key=repr)
    for r in got.filter("n_hit > 0").collect():
        assert sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_hit"]


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontam.find_contamination(docs(spark, [(1, "a")]).filter("false"), bench).count() == 0
    assert decontam.find_contamination(docs(spark, [(1, "a b c")]), bench.filter("false")).first()["n_hit"] == 0
    assert decontam.without_spans("A, b. C d é!", [{"lo": 1, "hi": 3}]) == "A,  d é!"


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(2)
    text = np.append(r.integers(1, 6, 3000), 0)
    index = decontam.FMIndex(text)
    patterns = r.integers(1, 6, (200, 6))
    length = r.integers(1, 7, 200)
    low, high = index.search(patterns, length)
    for p, n, a, b in zip(patterns, length, low, high):
        own = p[6 - n :].tolist()
        want = [i for i in range(len(text) - n) if text[i : i + n].tolist() == own]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_merkle_edits(spark):
    rows = odd_rows() + [(60, "One. Two! Three?\nFour " * 30), (61, "One. Two! Three?\nFour " * 30)]
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(new)))
    for parts in (1, 5):
        got = merkle.compare_edits(docs(spark, rows), parts).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert merkle.compare_edits(docs(spark, rows).filter("false"), 3).count() == 0
    single = merkle.compare_edits(docs(spark, [(1, "abcd")]), 3).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and single["near_next"] == 1.0


def test_merkle_trees():
    text = "".join(f"Sentence number {i} of this text is here. " for i in range(200))
    at = text.index("number 90 ")
    changed = text[:at] + "NUMBER" + text[at + 6 :]
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert "".join(merkle.paragraphs(text)) == text and merkle.parse(a)[0] != merkle.parse(b)[0]
    assert 0.97 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1 and merkle.likeness(a, merkle.fingerprint("x")) == 0
    assert [lo <= at < hi and hi - lo < 100 for lo, hi in merkle.differing(a, b)] == [True]
    assert merkle.fingerprint(None) == merkle.fingerprint("") and merkle.likeness(merkle.fingerprint(""), a) == 0
    assert "".join(merkle.paragraphs("z" * 500 + "\n\n.")) == "z" * 500 + "\n\n."


OLD = re.compile(r"[^\n]*?(?:[.!?]+[ \t]|\n)|[^\n]+", re.S)


def plain_paragraphs(text):
    out = []
    for part in OLD.findall(text):
        while len(part) > merkle.LONG:
            at = part.find(" ", merkle.LONG // 2, merkle.LONG) + 1 or merkle.LONG
            out.append(part[:at])
            part = part[at:]
        out.append(part)
    return out


def plain_likeness(a, b):
    """Characters of paragraphs both texts have, as a share of the longer text's: sections change nothing but the order of the search."""
    if a == b:
        return 1.0
    own, other = (collections.Counter(plain_paragraphs(t)) for t in (a, b))
    return sum(len(p) * n for p, n in (own & other).items()) / max(len(a), len(b))


def test_paragraphs_and_likeness(spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    odd = ["", "a.", ". . .", "a. \tb!? c\n\n x", "!" * 300, "! " * 300, "\n" * 5, "x" * 64 + " y", "x" * 65, "w " * 500 + ". " + "w" * 200 + "\n ."]
    for t in texts + odd:
        assert merkle.paragraphs(t) == plain_paragraphs(t)
    for a, b in zip(texts, texts[1:] + texts[:1]):
        new = merkle.edited(a, b)
        for x in (b, new):
            assert abs(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(x)) - plain_likeness(a, x)) < 1e-9


def test_paragraphs_take_time_in_proportion():
    for text in ("!" * 1_000_000, "x" * 10_000_000, "a.b" * 1_000_000, "! " * 500_000):
        begin = time.time()
        assert "".join(merkle.paragraphs(text)) == text
        assert time.time() - begin < 20


def plain_sections(text, encoding, rule):
    raw = text.encode()
    bounds = [0] + [i + 1 for i, c in enumerate(raw) if c == 10 or (c == 32 and i and raw[i - 1] in b".!?")]
    if len(bounds) == 1 or bounds[-1] < len(raw):
        bounds.append(len(raw))
    out, at, crossing = [0.0] * (len(bounds) - 1), 0, 0
    ids = encoding.encode_ordinary(text)
    for t in ids:
        end = at + len(encoding.decode_single_token_bytes(t))
        low, high = bisect.bisect_right(bounds, at) - 1, bisect.bisect_right(bounds, end - 1) - 1
        parts = [min(end, bounds[k + 1]) - max(at, bounds[k]) for k in range(low, high + 1)]
        crossing += high > low
        if rule == "split":
            for k, n in enumerate(parts):
                out[low + k] += n / (end - at)
        else:
            out[{"start": low, "end": high, "majority": low + parts.index(max(parts))}[rule]] += 1
        at = end
    return len(ids), crossing, out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens(spark, rule):
    rows = [r for r in odd_rows() if len(r[1] or "") < 20000] + [(70, "A b. C!\n\n\n\n  D? <|endoftext|> e.  f\n"), (71, "Ends. \n \n. x")]
    encoding, _ = tokens.encoder(tokens.read_ranks(VOCABULARY))
    got = tokens.section_tokens(docs(spark, rows), VOCABULARY, rule)
    have = collections.Counter((r["doc_id"], r["n_tokens"], r["n_crossing"], tuple(round(s["tokens"], 6) for s in r["sections"])) for r in got.collect())
    want = collections.Counter()
    for d, t in rows:
        n, crossing, parts = plain_sections(t or "", encoding, rule)
        want[d, n, crossing, tuple(round(x, 6) for x in parts)] += 1
        assert abs(sum(parts) - n) < 1e-6
    assert have == want
    assert tokens.section_tokens(docs(spark, rows).filter("false"), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        tokens.section_tokens(docs(spark, rows), VOCABULARY, "none")


def test_quality_holds_out_and_separates(spark):
    good = [(i, prose(60 + i % 50, i).capitalize() + ".") for i in range(0, 300, 2)]
    bad = [(i, " ".join(["BUY!! NOW$$$ ###"] * (10 + i % 30))) for i in range(1, 300, 2)]
    odd = [(1000, None), (1001, ""), (None, "x"), (1002, "word " * 50000)]
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in range(300)] + [(None, 1), (5, None), (9999, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs(spark, good + bad + odd), labels).collect()}
    assert len(got) == 304 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [d for d in got if d is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r["held_out"]} == set(held)
    assert all(got[d]["predicted"] == d % 2 ^ 1 for d in held if d < 300)
    # labels of held-out rows change nothing
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs(spark, good + bad + odd), turned).collect()}
    assert all(abs(again[d] - r["score"]) < 1e-9 for d, r in got.items())
    none = quality.quality_scores(docs(spark, good), labels.filter("false"))
    assert {r["score"] for r in none.collect()} == {1.0}
    assert quality.quality_scores(docs(spark, good).filter("false"), labels).count() == 0
    kept = quality.accepted(docs(spark, good + bad), labels)
    assert kept.columns == docs(spark, good).columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if d in dict(good + bad) and r["predicted"]}


def test_quality_log_density():
    r = np.random.default_rng(4)
    means, covariances = r.normal(size=(2, 3)), [np.cov(r.normal(size=(3, 9))) + np.eye(3) for _ in range(2)]
    model = quality.Discriminant(means, np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in covariances]), np.array([np.linalg.slogdet(c)[1] for c in covariances]), 0.3)
    x = r.normal(size=(5, 3))
    log = [-0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1]) for m, c in zip(means, covariances)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(log[1] - log[0] + 0.3))))


def test_mixing_meets_targets(spark):
    kinds = {"a": "alpha beta gamma", "b": "delta epsilon zeta", "c": "eta theta iota"}
    rows = [(i, f"{kinds['aabac'[i % 5]]} {prose(20 + i % 30, i)}") for i in range(400)] + [(None, None), (401, ""), (402, "alpha " * 20000)]
    labels = spark.createDataFrame([(i, "aabac"[i % 5]) for i in range(0, 400, 2)] + [(None, "a"), (1, "other")], "doc_id bigint, domain string")
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = mixing.soft_mixing(docs(spark, rows[:400]), labels, targets, extra=("text", "score")).collect()
    total = sum(r["n_tokens"] for r in got)
    for k, share in enumerate(targets.values()):
        assert abs(sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in got) / total - share) < 0.02
        assert abs(sum(r["copies"] * r["n_tokens"] * r["posterior"][k] for r in got) / total - share) < 0.1
    assert all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in got) and got[0]["score"] == "?"
    assert np.mean([np.argmax(r["posterior"]) == "abc".index("aabac"[r["doc_id"] % 5]) for r in got]) > 0.95
    odd = mixing.soft_mixing(docs(spark, rows), labels, targets)
    assert odd.count() == 403
    assert mixing.soft_mixing(docs(spark, rows).filter("false"), labels, targets).count() == 0
    assert mixing.soft_mixing(docs(spark, rows[:20]), labels.filter("false"), targets).count() == 20


def test_mixing_raises_no_limited_domain(spark):
    kinds = {"a": "alpha beta gamma", "b": "delta epsilon zeta", "c": "eta theta iota"}
    rows = [(i, f"{kinds[('a' * 16 + 'bbbc')[i % 20]]} {prose(20 + i % 30, i)}") for i in range(600)]
    labels = spark.createDataFrame([(i, ("a" * 16 + "bbbc")[i % 20]) for i in range(0, 600)], "doc_id bigint, domain string")
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.soft_mixing(docs(spark, rows), labels, targets, at_most=("b", "c")).collect()
    total = sum(r["n_tokens"] for r in got)
    before, after = (np.array([sum((r["rate"] if k else 1) * r["n_tokens"] * r["posterior"][d] for r in got) for d in range(3)]) / total for k in (0, 1))
    assert np.all(after[1:] <= before[1:] * 1.01) and before[1] < 0.2 and abs(after.sum() - 1) < 0.02
    assert min(r["copies"] for r in got if r["posterior"][0] > 0.9) >= 1  # nothing of the domain that may grow is lost
    assert np.allclose(mixing.limited(np.array([0.5, 0.3, 0.2]), np.array([0.8, 0.15, 0.05]), np.array([False, True, True])), [0.8, 0.15, 0.05])
    assert np.allclose(mixing.limited(np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.5, 0.4]), np.array([False, True, True])), [0.5, 0.3, 0.2])


def test_mixing_says_what_it_misses(spark):
    kinds = {"a": "alpha beta gamma", "b": "delta epsilon zeta"}
    rows = [(i, f"{kinds['aaab'[i % 4]]} {prose(20, i)}") for i in range(80)]
    labels = spark.createDataFrame([(i, "aaab"[i % 4]) for i in range(80)], "doc_id bigint, domain string")
    with pytest.warns(UserWarning, match="a target is missed by"):
        mixing.soft_mixing(docs(spark, rows), labels, {"a": 0.1, "b": 0.9}, steps=1)


def test_mixing_steps_reach_the_least_squares_solution():
    r = np.random.default_rng(1)
    p, w = r.dirichlet([0.3] * 3, 500), r.integers(1, 100, 500).astype(float)
    w /= w.sum()
    targets, ridge = np.array([0.7, 0.25, 0.05]), 0.05
    scale = 1 / np.sqrt(targets)
    step = 1 / (np.linalg.eigvalsh(scale[:, None] * ((p * w[:, None]).T @ p) * scale).max() + ridge)
    pulls = np.empty((0, 3))
    for _ in range(400):
        look = mixing.replay(p, pulls, step, ridge, True)
        pulls = np.vstack([pulls, ((w * look) @ p - targets) / targets])
    rate = mixing.replay(p, pulls, step, ridge, False)
    gradient = p @ (((w * rate) @ p - targets) / targets) + ridge * (rate - 1)
    assert np.all(rate >= 0) and np.all(np.abs(gradient[rate > 1e-6]) < 1e-4) and np.all(gradient[rate <= 1e-6] > -1e-4)


def test_registered_queries(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = [(r["doc_id"], r["text"]) for r in read("documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    got = QUERIES["op5_benchmark_decontamination"](spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_hits(rows, items)
    labels = {r["doc_id"]: r["quality"] for r in read("labels").collect()}
    scores = {r["doc_id"]: r for r in QUERIES["op8_quality_discriminant"](spark, sf_dir).collect()}
    held = [d for d in labels if scores[d]["held_out"]]
    assert np.mean([scores[d]["predicted"] == labels[d] for d in held]) > 0.9
    merkles = QUERIES["op7_merkle_fingerprints"](spark, sf_dir).collect()
    assert len(merkles) == len(rows) and np.mean([r["near_edited"] > r["near_next"] for r in merkles]) > 0.9
    encoding, _ = tokens.encoder(tokens.read_ranks(VOCABULARY))
    counts = {r["doc_id"]: r for r in QUERIES["op4_section_tokens"](spark, sf_dir).collect()}
    for d, t in rows:
        n, crossing, parts = plain_sections(t or "", encoding, "majority")
        assert (counts[d]["n_tokens"], counts[d]["n_crossing"], [s["tokens"] for s in counts[d]["sections"]]) == (n, crossing, parts)
    mixed = QUERIES["op2_soft_mixing"](spark, sf_dir).collect()
    total = sum(r["n_tokens"] for r in mixed)
    shares = [sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in mixed) / total for k in range(3)]
    assert len(mixed) == len(rows) and np.allclose(shares, [0.95, 0.04, 0.01], rtol=0.05)
