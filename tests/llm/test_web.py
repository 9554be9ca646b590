"""WARC round trips, URL rules, the pipeline, and the SQL of registered queries."""

import gzip
import hashlib
import re
from pathlib import Path

import pytest

import corpus_pipeline
from slotweave.llm import urls, warc
from slotweave.llm.plans import ORACLES, QUERIES, RULES
from slotweave.session import cut_lineage
from tests.llm.helpers import prose
from tools.check_oracle import compare, connect

PAGES = "page_id bigint, url string, html string, digest string, record string, data string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *("?" * 5)) for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    for t in ("pages", "documents"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    _, error = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert error is None


TRICKY = "\r\n\r\nWARC/1.1\r\n"


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_warc_round_trip(spark, tmp_path, size):
    long, tricky = prose(400, 1), ("é日" * 30 + TRICKY) * 20 + "WARC/1.1"
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (3, None, long), (3, None, long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (8, "u", tricky), (9, "u", tricky), (None, "u", long), (None, None, None), (10, "u", TRICKY), (11, "u", "\r\n\r\n"), (12, "u", "x" * 200000)]
    got = warc.round_trip(pages(spark, rows), str(tmp_path / "w"), size=size).collect()
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        last = max((p for p, _, h in rows if p is not None and h == html), default=None)
        again = len(raw) >= 1000 and page is not None and page < last
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    chunks = warc.read_archives(spark, str(tmp_path / "w")).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        assert len(r["data"]) <= size + 8
        whole[r["record"]] = whole.get(r["record"], b"") + bytes(r["data"])
    texts = [gzip.open(f).read() for f in Path(tmp_path / "w").glob("*.gz")]
    assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts if t)
    assert sorted(whole.values()) == sorted(b"" if w[3] == "revisit" else (r[2] or "").encode() for r, w in zip(rows, want))


def test_warc_edges(spark, tmp_path):
    assert warc.round_trip(pages(spark, [(1, "u", "x")]).filter("false"), str(tmp_path / "none")).count() == 0
    assert warc.cut_points(b"", 10) == [0] and warc.cut_points("日本語日本語".encode(), 10) == [9, 18]
    table = warc.chunk_table(spark.createDataFrame([("r", "a" * 25, 5)], "record string, payload string, more int"), 10).orderBy("chunk").collect()
    assert [(r["chunk"], r["bytes"], r["last"], r["more"]) for r in table] == [(0, 10, False, 5), (1, 20, False, None), (2, 25, True, None)]
    assert [r["digest"] for r in table] == [hashlib.sha1(b"a" * n).hexdigest() for n in (10, 20, 25)]


def test_warc_damage_is_noticed(spark, tmp_path):
    warc.round_trip(pages(spark, [(1, "u", "x" * 500)]), str(tmp_path / "w"), size=100)
    lines = b"".join(gzip.open(f).read() for f in Path(tmp_path / "w").glob("*.gz"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.txt").write_bytes(lines.replace(b"xxxxx", b"xxxxy", 1))
    with pytest.raises(Exception, match="not what was written"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()


def test_warc_blocks_that_end_in_line_ends(spark, tmp_path):
    """Revisits, null and empty payloads, and payloads ending in CRLF: the line ends before a version line vary in number."""
    n = 300_000
    html = "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN repeat('x', 1000) ELSE concat('p', id, repeat('\\r\\n', int(id % 5))) END AS html"
    table = spark.range(0, n, 1, 4).selectExpr("id AS page_id", "concat('http://h/', id, '/WARC/1.1') AS url", html)
    got = warc.round_trip(table, str(tmp_path / "w"))
    want = table.selectExpr("page_id", "coalesce(octet_length(html), 0) AS payload_bytes", "sha1(coalesce(html, '')) AS payload_digest")
    assert got.count() == n and got.select(want.columns).exceptAll(want).count() == 0
    assert got.filter("record_type = 'revisit'").count() == n // 4 - 1


def test_warc_lost_records_are_noticed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w")
    warc.round_trip(pages(spark, [(1, "u", "x" * 500)]).coalesce(1), path, size=100)
    lines = b"".join(gzip.open(f).read() for f in Path(path).glob("*.gz"))
    assert lines.count(b"WARC/1.1\r\n") == 5
    for name, bad, said in (("a", lines[: lines.rindex(b"WARC/1.1\r\n")], "last chunk .* is missing"), ("b", lines.replace(b"\nWARC/1.1\r\n", b"\nWARC/1.0\r\n", 1), "bytes up to the next one")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_bytes(bad)
        with pytest.raises(Exception, match=said):
            warc.read_archives(spark, str(tmp_path / name)).collect()
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **b: whole(*a, **b).filter("page_id <> '1'"))
    with pytest.raises(ValueError, match="2 records were written to .*, 1 read back"):
        warc.round_trip(pages(spark, [(1, "u", "x"), (2, "u", "y")]), str(tmp_path / "v"))


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, v in rules:
        if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), h + p, v))
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("few", [50_000, 0])
def test_url_filter(spark, monkeypatch, few):
    monkeypatch.setattr(urls, "FEW", few)
    rules = [*RULES, ("example.com", "/en/a", "block"), ("a.example.com", "/en", "allow"), ("é.fr", "", "block"), ("", "/x", "block"), (None, "/", "block"), ("org", None, "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block"), ("COM", "/up/", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    links = [
        None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://b.a.example.com/en/abc", "http://example.com/en/abc", "http://notexample.com/en/", "ftp://É.fr/ü", "http://é.fr",
        "http://x.net/es/1#q", "http://x.net/fr", "http://dup.org/", "http://a..com/", "http://.com/", "http://h?q=/en/", "http://h#://x/", "x://y://z/x", "http:///x", "http://a.com/up/1", "http://host:80/en/", "http://a.example.com/en/\nq",
    ]
    rows = [(i, u, "") for i, u in enumerate(links)] + [(0, None, ""), (None, "http://x.net/es/1", "")]
    got = urls.url_verdicts(pages(spark, rows), table)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain_verdict(u, [(h and h.lower(), p, v) for h, p, v in rules])) for i, u, _ in rows), key=repr)
    assert {r["verdict"] for r in urls.url_verdicts(pages(spark, rows), table.filter("false"), "block").collect()} == {"block"}
    assert urls.url_verdicts(pages(spark, rows).filter("false"), table).count() == 0


def test_url_filter_is_native(spark, sf_dir):
    plan = QUERIES["op6_url_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_pipeline(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        kept.append(docs)
    assert all(k.columns == documents.columns for k in kept[:-1]) and kept[-1].columns == [*documents.columns, "rate", "copy"]
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and len(ids[0]) < documents.count()
    scores = {r["doc_id"] for r in QUERIES["op8_quality_discriminant"](spark, sf_dir).filter("predicted = 1").collect()}
    assert ids[0] == scores
    bench = QUERIES["op5_benchmark_decontamination"](spark, sf_dir).filter("contaminated").select("doc_id").collect()
    assert not ids[3] & {r["doc_id"] for r in bench}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, kept[-1].collect()))
