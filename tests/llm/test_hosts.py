"""Document and host rules against a plain re-computation."""

import collections
import math
import re

import pytest

from slotweave.llm import hosts
from slotweave.llm.plans import QUERIES
from tests.llm.helpers import DOCS, SPACES, odd_rows, prose


def table(spark, rows):
    """Rows doc_id, text, source among clashing extra columns."""
    extra = ", host string, words string, windows string, n string, kept string"
    return spark.createDataFrame([(d, t, "en", s, 0, *("?" * 12)) for d, t, s in rows], DOCS + extra).repartition(3)


def statistics(text, width=8):
    text = text or ""
    words = re.findall(SPACES, text)
    lines = [x for x in text.split("\n") if re.search(SPACES, x)]
    found = collections.Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    mark = [False] * len(words)
    for i in range(len(words) - width + 1):
        if found[tuple(words[i : i + width])] > 1:
            mark[i : i + width] = [True] * width
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(mark)


def plain(rows, limit):
    stats = [(d, s, *statistics(t)) for d, t, s in rows]
    failed = [r[2] < 20 or 100 * r[6] > 30 * r[2] for r in stats]
    n, f = collections.Counter(), collections.Counter()
    for r, bad in zip(stats, failed):
        if r[1] is not None:
            n[r[1]] += 1
            f[r[1]] += bad
    total, mean = sum(n.values()), sum(f.values()) / max(1, sum(n.values()))
    chance, k = mean * (1 - mean), len(n)
    room = total - sum(x * x for x in n.values()) / total - (k - 1) if total else 0
    strength = 1e6
    if chance > 0 and room > 0:
        within = (sum(n[s] * (f[s] / n[s] - mean) ** 2 for s in n) / chance - (k - 1)) / room
        strength = min(max(1 / within - 1, 1e-3), 1e6) if within > 0 else 1e6
    rate = {s: (f[s] + mean * strength) / (n[s] + strength) for s in n}
    return [(*r, bad, rate.get(r[1]), not bad and not (r[1] in rate and rate[r[1]] >= limit)) for r, bad in zip(stats, failed)]


def rows():
    texts = odd_rows() + [(20, "a b c d e f g h " * 30), (21, "one two\none two\n \n\none two \none two"), (22, "x " * 7), (23, "x " * 8), (24, "x " * 9), (25, "# $ <b> | & % * >\n" * 5), (26, prose(25, 9) + " " + prose(25, 9))]
    out = [(d, t, None if i % 7 == 0 else f"h{i % 3}") for i, (d, t) in enumerate(texts)]
    out += [(100 + i, prose(30, i), "good") for i in range(40)] + [(200 + i, prose(5 if i % 10 else 30, i), "bad") for i in range(40)]
    out += [(300 + i, prose(5, i), f"single{i}") for i in range(3)] + [(400, prose(30, 1), "bad"), (400, prose(30, 1), "bad"), (401, prose(40, 1), None), (402, prose(40, 1), "")]
    return out


@pytest.mark.parametrize("limit, hot", [(0.5, 1000), (0.5, 4), (0.2, 1), (2.0, 1000)])
def test_verdicts(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(hosts, "HOT", hot)
    got = hosts.host_quality(table(spark, rows()), limit=limit)
    assert got.columns == ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"]
    flat = lambda rs: sorted(((*r[:8], None if r[8] is None else round(r[8], 9), r[9]) for r in rs), key=repr)
    assert flat(map(tuple, got.collect())) == flat(plain(rows(), limit))
    kept = collections.Counter((r["host"], r["base_failed"], r["kept"]) for r in got.collect())
    assert (kept["bad", False, True] > 0) == (limit == 2.0) and kept["good", False, True] == (40 if limit != 0.2 else kept["good", False, True])


def test_edges(spark):
    assert hosts.host_quality(table(spark, rows()).filter("false")).count() == 0
    nameless = [(i, t, None) for i, t, _ in rows()]
    assert all(r["kept"] is not r["base_failed"] and r["host_rate"] is None for r in hosts.host_quality(table(spark, nameless)).collect())
    one = hosts.host_quality(table(spark, [(1, prose(30), "a"), (2, "x", "a")])).collect()
    assert {(r["doc_id"], r["kept"]) for r in one} == {(1, False), (2, False)}  # half of the only host's rows fail


def test_prior(spark):
    """Many hosts drawn from a known prior: its mean and strength come back."""
    import numpy as np

    r = np.random.default_rng(5)
    n = r.integers(1, 200, 4000)
    f = r.binomial(n, r.beta(2, 6, 4000))
    got = hosts.prior(spark.createDataFrame([(str(i), int(a), int(b)) for i, (a, b) in enumerate(zip(n, f))], "host string, n bigint, failed bigint"))
    assert abs(got.mean - 0.25) < 0.02 and abs(got.strength - 8) < 1.0
    even = hosts.prior(spark.createDataFrame([(str(i), 100, 25) for i in range(50)], "host string, n bigint, failed bigint"))
    assert (even.mean, even.strength) == (0.25, hosts.STRENGTH[1])
    far = hosts.prior(spark.createDataFrame([(str(i), 100, 100 * (i % 2)) for i in range(50)], "host string, n bigint, failed bigint"))
    assert far.strength == pytest.approx(hosts.STRENGTH[0], abs=0.05) and math.isclose(far.mean, 0.5)


def test_long_text(spark):
    text = prose(200_000, 1, 10**9) + " " + "same words again and again and once more " * 20_000
    got = hosts.document_statistics(table(spark, [(1, text, "a")])).first()
    assert tuple(got)[2:] == statistics(text)


def test_native(spark, sf_dir, monkeypatch):
    """No Python worker, cross join or nested loop in any plan of the query."""
    plans, cut = [], hosts.cut_lineage
    monkeypatch.setattr(hosts, "cut_lineage", lambda df: (plans.append(df), cut(df))[1])
    plans.append(QUERIES["op12_host_rules"](spark, sf_dir))
    assert len(plans) == 3
    for df in plans:
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())
