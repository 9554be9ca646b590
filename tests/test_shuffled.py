"""What jobs shuffle and how often they read their input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotweave import fixtures as X
from slotweave.operators import ordered
from slotweave.plans import relational  # noqa: F401 registers the queries
from slotweave.plans.registry import QUERIES
from tests.conftest import SF, rows


@pytest.fixture
def joins_by_shuffle(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    yield
    spark.conf.unset(name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mentions_are_not_shuffled(spark, joins_by_shuffle):
    """Accounts are dealt by signature as they are, without the flags made of them."""
    lines = plan(QUERIES["k4_cascade_mentions"](spark, SF)).splitlines()
    dealt = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning(signature" in line]
    assert dealt and not any("zip_with" in line for line in dealt)


def test_stake_requests_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)

    table = spark.range(600).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("string").alias("operator"), F.col("id").alias("seq"), (F.col("id") * 37 % 50).alias("amount")
    )
    made = ordered.stake_with_cap(table.mapInArrow(counted, table.schema), 5, 1000, chunk=10)
    got = rows(made, "operator", "seq", "decision")
    assert read.value == 600
    total, want = {}, []
    for r in table.orderBy("seq").collect():
        fits = total.get(r["operator"], 0) + r["amount"] <= 1000
        if r["amount"] >= 5 and fits:
            total[r["operator"]] = total.get(r["operator"], 0) + r["amount"]
        want.append((r["operator"], r["seq"], "below minimum" if r["amount"] < 5 else "accepted" if fits else "over cap"))
    assert got == sorted(want, key=repr)


def test_items_are_shuffled_without_what_no_instruction_shows(spark, views, joins_by_shuffle):
    made = [line for line in plan(views.transactions).splitlines() if "Aggregate" in line]
    assert made and not any("l_shipdate" in line or "l_extendedprice" in line for line in made)


def test_items_keep_their_order(spark):
    """Items of one part and supplier: two that differ, and two that are the same; the part is listed twice."""
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    item = lambda n, price: (1, 5, 7, n, 1.0, price, 0.0, 0.0, None, "O", None)
    part = spark.createDataFrame([(5, "A", 1), (5, "B", 2)], "p_partkey bigint, p_brand string, p_size int")
    order = spark.createDataFrame([(1, 2, "O", 3.0, "5-LOW", None)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate date")
    programs = lambda *items: [i["program_id"] for i in X.transactions(order, spark.createDataFrame(list(items), line), part).first()["instructions"]]
    assert programs(item(1, 2.0), item(2, 2.0)) == ["A", "B", "A", "B"]
    assert programs(item(1, 2.0), item(1, None)) == ["A", "B", "A", "B"]
    assert programs(item(1, 2.0), item(1, 2.0)) == ["A", "A", "B", "B"]
