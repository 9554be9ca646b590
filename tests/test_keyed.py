"""Tables of runs: what is in force, what an upsert touches, snapshots, and replays."""

import random

import pytest
from pyspark.sql import functions as F

from slotweave.operators import index, topk
from slotweave.operators.lookups import transactions_by_account
from slotweave.sources import tables, tiers
from slotweave.sources.keyed import KeyedTable
from tests.conftest import rows

SCHEMA = "k bigint, name string, v bigint, at bigint"


def table(spark, path, **options):
    return KeyedTable(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ["k", "name"], ["at"], **({"buckets": 4, "fan": 2, "keep": 3} | options))


def batches(n, seed=1):
    r = random.Random(seed)
    return [[(r.choice([*range(12), None]), r.choice(["x", None]), r.randrange(100), 100 * b + i) for i in range(8)] for b in range(n)]


def current(parts):
    return sorted({(k, name): (k, name, v, at) for part in parts for k, name, v, at in part}.values(), key=repr)


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_upserts(spark, tmp_path, fan):
    own, parts = table(spark, tmp_path, fan=fan), batches(7)
    assert own.read().count() == 0 and own.versions() == []
    for b, part in enumerate(parts):
        assert own.upsert(spark.createDataFrame(part, SCHEMA), b) == b + 1
        assert rows(own.read()) == current(parts[: b + 1])
    held = own.manifest()
    levels = [(n, b) for n, buckets in held.runs.values() for b in buckets]
    assert max(levels.count(x) for x in levels) < max(fan, 8) and (fan == 100 or max(n for n, _ in levels) >= 1)
    assert all(levels.count(x) < fan for x in levels)
    # replayed and empty batches
    assert own.upsert(spark.createDataFrame(parts[0], SCHEMA), 3) == 7
    assert own.upsert(spark.createDataFrame([], SCHEMA), 7) == 8
    assert rows(own.read()) == current(parts)
    for k, name in ((3, "x"), (None, None), (99, "x")):
        assert rows(own.read_keys(k, name)) == [r for r in current(parts) if r[:2] == (k, name)]
    some = spark.createDataFrame([(3, "x"), (None, None), (77, None)], "k bigint, name string")
    assert rows(own.read_buckets_of(some)) == [r for r in current(parts) if r[:2] in ((3, "x"), (None, None))]


def test_a_reader_keeps_its_version(spark, tmp_path):
    own, parts = table(spark, tmp_path), batches(6)
    own.upsert(spark.createDataFrame(parts[0], SCHEMA), 0)
    before = own.read()
    for b in (1, 2):  # merged and replaced meanwhile
        own.upsert(spark.createDataFrame(parts[b], SCHEMA), b)
    assert rows(before) == current(parts[:1]) and rows(own.read(version=1)) == current(parts[:1])
    for b in (3, 4, 5):
        own.upsert(spark.createDataFrame(parts[b], SCHEMA), b)
    assert own.versions() == [4, 5, 6]
    with pytest.raises(ValueError, match="no version 1 any more"):
        own.read(version=1)
    named = {run for v in own.versions() for run in own.manifest(v).runs}
    assert {p.name for p in (tmp_path / "runs").iterdir() if not p.name.startswith(".")} == named


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    own = table(spark, tmp_path, buckets=8, fan=2)
    own.upsert(spark.createDataFrame([(i, "x", i, 0) for i in range(200)], SCHEMA))
    first = next(iter(own.manifest().runs))
    own.upsert(spark.createDataFrame([(5, "x", 1, 1)], SCHEMA))
    runs = own.manifest().runs
    merged = [b for run, (level, b) in runs.items() if level == 1]
    assert len(merged) == 1 and len(merged[0]) == 1 and len(runs[first][1]) == 7 and merged[0][0] not in runs[first][1]


def test_a_run_without_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    own, parts = table(spark, tmp_path, keep=1), batches(3)
    own.upsert(spark.createDataFrame(parts[0], SCHEMA), 0)
    monkeypatch.setattr(own, "_commit", lambda m: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        own.upsert(spark.createDataFrame(parts[1], SCHEMA), 1)
    assert rows(own.read()) == current(parts[:1])
    again = table(spark, tmp_path, keep=1)
    for b in (1, 2):
        again.upsert(spark.createDataFrame(parts[b], SCHEMA), b)
    assert rows(again.read()) == current(parts)
    assert len(list((tmp_path / "manifests").glob("*.json"))) == 1


def test_index_is_idempotent_and_cut(spark, views, tmp_path):
    path, tx = str(tmp_path / "index"), views.transactions
    for part in (0, 1, 2, 1, 0):
        index.write_index(tx.filter(F.col("slot") % 3 == part), "accounts", path, buckets=8, depth=30)
    whole = tx.select(F.explode(F.array_distinct("accounts")).alias("key"), "signature", "slot", "idx")
    hot = whole.groupBy("key").count().orderBy(F.col("count").desc(), "key").first()
    assert hot["count"] > 30
    got = index.read_by_key(spark, path, hot["key"], None, buckets=8)
    newest = [(r["signature"],) for r in whole.filter(F.col("key") == hot["key"]).orderBy(F.col("slot").desc(), F.col("idx").desc()).limit(30).collect()]
    assert sorted((r["signature"],) for r in got.orderBy(F.col("slot").desc(), F.col("idx").desc()).limit(30).collect()) == sorted(newest)
    assert rows(got, "signature") == sorted(set(rows(got, "signature")))
    assert rows(index.read_by_key(spark, path, hot["key"], 25, buckets=8), "signature") == rows(transactions_by_account(tx, hot["key"], 25), "signature")


def test_index_merges_runs(spark, views, tmp_path):
    path, tx = str(tmp_path / "index"), views.transactions
    schema = tx.select(F.lit("").alias("key"), "signature", "slot", "idx").schema
    own = index.IndexTable(spark, path, schema, depth=5, buckets=2, fan=2)
    for part in range(4):
        own.upsert(tx.filter(F.col("slot") % 4 == part).select(F.explode("program_ids").alias("key"), "signature", "slot", "idx"))
    assert [level for level, _ in own.manifest().runs.values()] == [2]
    assert own.read().groupBy("key").count().agg(F.max("count")).first()[0] == 5
    assert len(own.read_keys("Brand#13").inputFiles()) == 1


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_newest_rows(spark, views, tmp_path, limit):
    path = str(tmp_path / "tx")
    tx = views.transactions.withColumn("slot", F.when(F.col("slot") % 17 != 3, F.col("slot")))
    tables.write_bucketed(tx, path, width=40)
    for where in (None, topk.mentions("Brand#13"), F.col("fee") < 0):
        got = tables.read_newest(spark, tx.schema, path, limit, where=where)
        want = (tx if where is None else tx.filter(where)).orderBy(F.col("slot").desc(), F.col("idx").desc(), ).limit(limit)
        assert rows(got, "slot") == rows(want, "slot")
        if limit == 10_000:
            assert rows(got, "signature") == rows(want, "signature")
    some = tables.read_newest(spark, tx.schema, path, 1)
    assert len(some.inputFiles()) < len(spark.read.parquet(path).inputFiles()) / 4


def test_newest_rows_of_an_empty_table(spark, views, tmp_path):
    path = str(tmp_path / "tx")
    tables.write_bucketed(views.transactions.filter("false"), path)
    assert tables.read_newest(spark, views.transactions.schema, path, 5).count() == 0


# --- hot and cold ---------------------------------------------------------------------------------


def _updates(spark, lo, hi, note):
    return spark.range(lo, hi).select((F.col("id") * 7 % 100).alias("slot"), F.col("id").alias("seq"), F.lit(note).alias("note"))


def test_moves_and_reads_in_turns(spark, tmp_path):
    schema = _updates(spark, 0, 1, "").schema
    table = tiers.TieredTable(spark, str(tmp_path / "hot"), str(tmp_path / "cold"), schema, width=10)
    assert table.read().count() == 0 and table.cut() is None
    parts, snapshots = [], []
    for k, slot in enumerate((0, 35, 35, 20, 71, 200)):
        parts.append(_updates(spark, 100 * k, 100 * k + 100, f"n{k}"))
        table.append(parts[-1])
        want = rows(parts[0]) if k == 0 else sorted(r for p in parts for r in rows(p))
        before = table.read()
        assert rows(before) == sorted(want, key=repr)
        table.move(slot)
        assert rows(before) == sorted(want, key=repr)  # taken before the move, read after it
        assert rows(table.read()) == sorted(want, key=repr)
        some = [r for r in want if 33 <= r[0] <= 48]
        assert rows(table.read(33, 48)) == sorted(some, key=repr)
        snapshots.append(table.cut())
    assert snapshots == [0, 3, 3, 3, 7, 20]
    assert len(table.read(33, 36).inputFiles()) < len(table.read().inputFiles())


def test_a_failed_move_is_made_again(spark, tmp_path, monkeypatch):
    data = _updates(spark, 0, 300, "a")
    table = tiers.TieredTable(spark, str(tmp_path / "hot"), str(tmp_path / "cold"), data.schema, width=10)
    table.append(data)
    commit = tiers.commit_manifest
    monkeypatch.setattr(tiers, "commit_manifest", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.move(50)
    assert table.cut() is None and rows(table.read()) == rows(data)
    monkeypatch.setattr(tiers, "commit_manifest", commit)
    assert table.move(50) == 5 and rows(table.read()) == rows(data)
    table.append(_updates(spark, 0, 10, "late"))
    assert rows(table.read()) == rows(data.unionByName(_updates(spark, 0, 10, "late")))
    assert not [b for b in table._buckets(str(tmp_path / "cold")) if b >= 5]
