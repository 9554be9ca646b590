"""The stored index: what a lookup reads, and what it gives."""

from slotweave.operators.index import read_by_key, write_index
from slotweave.operators.lookups import transactions_by_account
from tests.conftest import rows


def test_lookup_reads_one_bucket(spark, views, tmp_path):
    path = str(tmp_path / "index")
    tx = views.transactions
    for part in (0, 1):
        write_index(tx.filter(tx["slot"] % 2 == part), "accounts", path, buckets=8)
    got = read_by_key(spark, path, "supp7", 25, buckets=8)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,supp7)" in text and "TakeOrderedAndProject" in text
    files = got.inputFiles()
    assert len(files) == 2 and len({f.split("_bucket=")[1].split("/")[0] for f in files}) == 1  # a file of each of two runs
    assert rows(got, "signature") == rows(transactions_by_account(tx, "supp7", 25), "signature")
    assert read_by_key(spark, path, "nobody", None, buckets=8).count() == 0
