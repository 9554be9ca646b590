"""What streaming queries report about themselves, kept as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from slotweave.session import file_store

SCHEMA = "query STRING, name STRING, batch BIGINT, at TIMESTAMP, rows_in BIGINT, rows_per_second DOUBLE, state_rows BIGINT, late_rows BIGINT, metrics MAP<STRING, MAP<STRING, BIGINT>>"


def _numbers(row) -> dict[str, int]:
    return {k: int(v) for k, v in row.asDict().items() if v is not None}


def progress_row(progress) -> dict:
    """One row of the metrics table. ``late_rows`` are those that a watermark dropped."""
    states = progress.stateOperators
    return {
        "query": str(progress.id), "name": progress.name, "batch": progress.batchId, "at": progress.timestamp, "rows_in": progress.numInputRows,
        "rows_per_second": progress.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in states), "late_rows": sum(s.numRowsDroppedByWatermark for s in states),
        "metrics": {name: _numbers(row) for name, row in progress.observedMetrics.items()},
    }


class MetricsTable(StreamingQueryListener):
    """Writes the progress of every micro-batch of the session's queries under ``path``.

    A file is named by query and batch, so a batch that is run again after a restart replaces its own numbers. A report that
    has nothing new (an idle trigger) is not written.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows and not p.observedMetrics:
            return
        store, file = file_store(self.spark, f"{self.path}/{p.id}-{p.batchId:012d}.json")
        out = store.create(file, True)
        out.write(bytearray(json.dumps(progress_row(p)).encode()))
        out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def listen(spark: SparkSession, path: str) -> MetricsTable:
    """Start recording; ``spark.streams.removeListener`` ends it."""
    table = MetricsTable(spark, path)
    spark.streams.addListener(table)
    return table


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch."""
    return spark.read.schema(SCHEMA).json(path)


def totals(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """Sums over all batches of a query of what it observes as ``metric``: query, counter and total."""
    each = read_metrics(spark, path).select("query", F.explode(F.col("metrics")[metric]).alias("counter", "n"))
    return each.groupBy("query", "counter").agg(F.sum("n").alias("total"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped since the query's start, as far as its recent progress goes back."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
