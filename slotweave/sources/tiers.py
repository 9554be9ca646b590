"""A table in two stores, hot and cold, with a cut that moves.

Both stores keep slot buckets. A manifest names the first bucket that is read from the hot one; all before it are read from the cold one. Moving the cut
copies whole buckets, then commits the manifest, and the hot copies go only with the next move. So a read, which takes one manifest, sees each
row once, whatever is being moved, and a move that fails half-way is simply made again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.session import file_store
from slotweave.sources.keyed import commit_manifest, drop_manifest, read_manifest, versions
from slotweave.sources.tables import SLOT_BUCKET_WIDTH, newest_buckets, with_slot_bucket

KEEP = 10  # manifests


class TieredTable:
    """``hot`` and ``cold`` are folders, in whatever stores; manifests are in the hot one. Rows need a slot."""

    def __init__(self, spark: SparkSession, hot: str, cold: str, schema: T.StructType, width: int = SLOT_BUCKET_WIDTH):
        self.spark, self.hot, self.cold, self.schema, self.width = spark, hot, cold, schema, width

    def cut(self, version: int | None = None) -> int | None:
        """First bucket of the hot store; ``None`` as long as all are hot."""
        held = read_manifest(self.spark, self.hot, version)
        return held["cut"] if held else None

    def _buckets(self, path: str) -> list[int]:
        store, folder = file_store(self.spark, path)
        return newest_buckets(self.spark, path) if store.exists(folder) else []

    def append(self, rows: DataFrame) -> None:
        """Add rows where they are read from: late ones, behind the cut, to the cold store."""
        cut = self.cut()
        own = with_slot_bucket(rows.select(*self.schema.names), self.width)
        parts = [(self.hot, own)] if cut is None else [(self.hot, own.filter(F.col("slot_bucket") >= cut)), (self.cold, own.filter(F.col("slot_bucket") < cut))]
        for path, part in parts:
            part.hint("rebalance", "slot_bucket").write.mode("append").partitionBy("slot_bucket").parquet(path)

    def read(self, lo: int | None = None, hi: int | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of an inclusive slot range: only its buckets are opened."""
        cut = self.cut(version)
        inside = lambda b: (lo is None or b >= lo // self.width) and (hi is None or b <= hi // self.width)
        folders = [f"{self.hot}/slot_bucket={b}" for b in self._buckets(self.hot) if inside(b) and (cut is None or b >= cut)]
        if cut is not None:
            folders += [f"{self.cold}/slot_bucket={b}" for b in self._buckets(self.cold) if inside(b) and b < cut]
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        rows = rows if lo is None else rows.filter(F.col("slot") >= lo)
        return rows if hi is None else rows.filter(F.col("slot") <= hi)

    def move(self, slot: int) -> int:
        """Let the hot store begin with the bucket that ``slot`` is in; buckets before it go to the cold one. A cut never moves back.

        One job copies them, each bucket over what an earlier, failed move may have left. What the last move left hot is deleted first.
        """
        old, new = self.cut(), slot // self.width
        if old is not None and new <= old:
            return old
        store, _ = file_store(self.spark, self.hot)
        hot = self._buckets(self.hot)
        for b in (b for b in hot if old is not None and b < old):
            store.delete(file_store(self.spark, f"{self.hot}/slot_bucket={b}")[1], True)
        moving = [b for b in hot if b < new and (old is None or b >= old)]
        if moving:
            rows = self.spark.read.schema(self.schema).parquet(*[f"{self.hot}/slot_bucket={b}" for b in moving])
            dealt = with_slot_bucket(rows, self.width).hint("rebalance", "slot_bucket")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot_bucket").parquet(self.cold)
        known = versions(self.spark, self.hot)
        commit_manifest(self.spark, self.hot, known[-1] + 1 if known else 1, {"cut": new})
        for v in known[: -KEEP + 1]:
            drop_manifest(self.spark, self.hot, v)
        return new
