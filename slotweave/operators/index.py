"""A stored secondary index: program or account to the newest transactions that mention it.

It is a table of runs by hash of the key (``sources.keyed``). A lookup opens the runs of one bucket, fewer than ``fan`` of each level, and in them only the
row groups whose Bloom filter and bounds allow the key. Taking a slot bucket in again changes nothing: pairs are
unique. Runs are merged level by level, and a merge cuts each key to its newest ``depth``, so a hot key costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.operators.lookups import build_index
from slotweave.operators.ordered import top_per_key
from slotweave.sources.keyed import RunTable

BUCKETS = 256
KEEP = ["signature", "slot", "idx"]
ORDER = ["slot", "idx"]
DEPTH = 1000  # transactions of a key


class IndexTable(RunTable):
    """Rows key, ``unique`` and what orders them: of each key the newest ``depth`` (all for ``None``)."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, unique: str = "signature", order: list[str] = ORDER, depth: int | None = DEPTH,
        buckets: int = BUCKETS, fan: int = 8, keep: int = 10,
    ):
        super().__init__(spark, path, schema, ["key"], buckets, fan, keep)
        self.unique, self.order, self.depth = unique, order, depth

    def reduced(self, rows: DataFrame) -> DataFrame:
        once = rows.dropDuplicates(["key", self.unique])
        return once if self.depth is None else top_per_key(once, ["key"], self._newest(), self.depth, salt=64).drop("rn")

    def _newest(self) -> list[Column]:
        return [F.col(c).desc() for c in self.order]

    def sorting(self) -> list[Column]:
        return [F.col("key"), *self._newest()]

    def options(self) -> dict[str, str]:
        return {"parquet.bloom.filter.enabled#key": "true"}


def _table(spark: SparkSession, path: str, schema: T.StructType, buckets: int, order: list[str], depth: int | None) -> IndexTable:
    return IndexTable(spark, path, schema, order=order, depth=depth, buckets=buckets)


def write_index(
    tx: DataFrame, array: str, path: str, keep: list[str] = KEEP, buckets: int = BUCKETS, order: list[str] = ORDER, depth: int | None = DEPTH, batch: int | None = None
) -> int:
    """Take in the transactions of some slots, by the keys in the array column; the index's version that has them.

    Call it for each new slot bucket, and again for one that has changed. With ``batch`` numbers of a stream, a replayed batch is not even read.
    """
    rows = build_index(tx, array, "key", keep)
    return _table(tx.sparkSession, path, rows.schema, buckets, order, depth).upsert(rows, batch)


def read_by_key(
    spark: SparkSession, path: str, key: str, limit: int | None = 10, buckets: int = BUCKETS, order: list[str] = ORDER, keep: str = "signature STRING, slot BIGINT, idx BIGINT"
) -> DataFrame:
    """The newest ``limit`` entries of a key (all that the index has for ``None``), with the columns that ``keep`` declares."""
    schema = T.StructType([T.StructField("key", T.StringType()), *T.StructType.fromDDL(keep).fields])
    rows = _table(spark, path, schema, buckets, order, None).read_keys(key)
    return rows if limit is None else rows.orderBy(*[F.col(c).desc() for c in order]).limit(limit)
