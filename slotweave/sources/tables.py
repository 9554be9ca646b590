"""Parquet tables with fixed schemas, slot-bucket layout and the hot/cold pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.schemas import TABLES, schema
from slotweave.session import drop_folder, file_store, work_path

SLOT_BUCKET_WIDTH = 432_000  # slots of one epoch


def read_table(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Scan with the declared schema: no inference job, and types never drift between files."""
    return spark.read.schema(TABLES[kind]).parquet(path)


def read_tables(
    spark: SparkSession, root: str, index_types: str, selectors: dict[str, object] | None = None
) -> dict[str, DataFrame]:
    """The feeds named in ``"accounts,transactions,blocks"``.

    With ``selectors`` given, accounts and transactions are also off unless they have one.
    """
    names = [n.strip() for n in index_types.split(",") if n.strip()]
    unknown = [n for n in names if n not in TABLES]
    if unknown:
        raise ValueError(f"unknown table(s): {', '.join(unknown)}")
    if selectors is not None:
        names = [n for n in names if n not in ("accounts", "transactions") or selectors.get(n) is not None]
    return {n: read_table(spark, n, f"{root}/{n}") for n in names}


def write_table(
    df: DataFrame,
    path: str,
    compression: str = "snappy",
    max_records: int = 0,
    max_file_mb: int | None = None,
    partition_by: list[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Parquet sink. ``max_records`` rolls files by row count.

    ``max_file_mb`` rolls by size: a file takes as many rows as fit by ``rows_per_file``, and rows are rebalanced first, so that small partitions
    don't make small files. ``df`` is read once more for that. No setting of the session is changed.
    """
    if max_file_mb:
        fit = rows_per_file(df, max_file_mb << 20, compression)
        max_records = min(max_records or fit, fit)
        df = df.hint("rebalance", *(partition_by or []))
    writer = df.write.mode(mode).option("compression", compression)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def rows_per_file(df: DataFrame, limit: int, compression: str = "snappy", sample: int = 2000) -> int:
    """How many rows of ``df`` a Parquet file of ``limit`` bytes takes.

    The first ``sample`` rows of each partition are written to a scratch folder; the partition with the most bytes a row decides, so files
    stay below the limit where rows differ in size between partitions; those with smaller rows are then well below it. A file has one row at least.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, "cut")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of a row in its partition
    df.withColumn("_place", place).filter(F.col("_place") < sample).drop("_place").write.option("compression", compression).parquet(path)
    files = spark.read.schema(df.schema).parquet(path).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").count()
    widest = files.agg(F.max(F.col("file_size") / F.col("count"))).first()[0]
    drop_folder(spark, path)
    return max(1, int(0.95 * limit / widest)) if widest else 1 << 31  # parts of a partition differ a little


# --- slot buckets -----------------------------------------------------------------------------


def slot_bucket(slot: str | Column, width: int = SLOT_BUCKET_WIDTH) -> Column:
    c = F.col(slot) if isinstance(slot, str) else slot
    return F.floor(c / F.lit(width)).cast("bigint")


def with_slot_bucket(df: DataFrame, width: int = SLOT_BUCKET_WIDTH) -> DataFrame:
    return df.withColumn("slot_bucket", slot_bucket("slot", width))


def write_bucketed(df: DataFrame, path: str, width: int = SLOT_BUCKET_WIDTH, **options) -> None:
    """One folder per slot range. The rebalance hint keeps the file count near one per bucket
    and still splits a bucket that is too large for one task."""
    rows = with_slot_bucket(df, width).hint("rebalance", "slot_bucket")
    write_table(rows, path, partition_by=["slot_bucket"], **options)


def read_bucketed(
    spark: SparkSession, kind: str, path: str, lo: int, hi: int, width: int = SLOT_BUCKET_WIDTH
) -> DataFrame:
    """Inclusive slot range. The predicate is put on the bucket column as well, because Catalyst
    cannot derive it; only the folders of the range are listed and read."""
    fields = [*schema(kind).fields, T.StructField("slot_bucket", T.LongType())]
    df = spark.read.schema(T.StructType(fields)).parquet(path)
    inside = F.col("slot_bucket").between(lo // width, hi // width) & F.col("slot").between(lo, hi)
    return df.filter(inside).drop("slot_bucket")


def newest_buckets(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the slot buckets that are there, from the newest."""
    store, folder = file_store(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    return sorted((int(n.partition("=")[2]) for n in names if n.startswith("slot_bucket=") and n.partition("=")[2].lstrip("-").isdigit()), reverse=True)


def read_newest(
    spark: SparkSession, table: str | T.StructType, path: str, limit: int, order: list[str] = ["slot", "idx"], where: Column | None = None
) -> DataFrame:
    """The newest ``limit`` rows that ``where`` holds for, of a table written by ``write_bucketed``; ``order`` begins with the slot.

    Buckets are walked from the newest, in twice as many at each step, until they hold enough rows: later slots are in later buckets, so
    what is read depends on ``limit`` and on how rare the rows are, not on the history. Rows without a slot are the oldest.
    """
    schema_ = schema(table) if isinstance(table, str) else table
    descending = [F.col(c).desc() for c in order]

    def rows(buckets: list[int]) -> DataFrame:
        found = spark.read.schema(schema_).parquet(*[f"{path}/slot_bucket={b}" for b in buckets]) if buckets else spark.createDataFrame([], schema_)
        return found if where is None else found.filter(where)

    every, taken, step, have = newest_buckets(spark, path), [], 1, 0
    while every and have < limit:
        new, every = every[:step], every[step:]
        have += rows(new).select(F.lit(1)).limit(limit - have).count()
        taken, step = taken + new, step * 2
    if have < limit:
        store, none = file_store(spark, f"{path}/slot_bucket=__HIVE_DEFAULT_PARTITION__")
        taken += ["__HIVE_DEFAULT_PARTITION__"] if store.exists(none) else []
    return rows(taken).orderBy(*descending).limit(limit)


# --- hot and cold -----------------------------------------------------------------------------


def split_hot_cold(df: DataFrame, slot_cut: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("slot") >= slot_cut), df.filter(F.col("slot") < slot_cut)


def read_hot_cold(hot: DataFrame, cold: DataFrame, key: str) -> DataFrame:
    """Both stores as one table; a key held by both is read from the hot one."""
    return hot.unionByName(cold.join(hot.select(key), key, "left_anti"))


# --- relational databases (not exercised here: no database is available) -----------------------


def read_jdbc(spark: SparkSession, url: str, name: str, lo: int, hi: int, parts: int, **options) -> DataFrame:
    """Parallel range scan of a stored table, split on ``slot``."""
    return spark.read.jdbc(url, name, "slot", lo, hi, parts, properties=options)


def write_jdbc(df: DataFrame, url: str, name: str, batch: int = 1000, **options) -> None:
    df.write.jdbc(url, name, mode="append", properties={"batchsize": str(batch), **options})


# --- payload versions -------------------------------------------------------------------------


def normalize_versions(kind: str, *versions: DataFrame) -> DataFrame:
    """Feeds of different payload versions as one table; fields a version lacks are NULL."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)
    known = set(merged.columns)
    return merged.select(
        [
            (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(kind).fields
        ]
    )
