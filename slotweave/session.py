"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


#: Bytes of rows that go to a Python worker at once: it holds several copies of them while it works, and an executor has many workers.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, bound what Python workers get at once, and ship this package to the executors.

    Unix seconds and timestamps must agree everywhere, and functions that run in Python workers import this package by name.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(_BATCH) == "67108864b":  # the default; what a user has set stays
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to all executors, once per application; Spark's file server hands them out."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="slotweave-code-"), "slotweave_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    root = tempfile.mkdtemp(prefix="slotweave-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never used twice."""
    return os.path.join(shared_root(spark), "slotweave", f"{name}-{uuid.uuid4().hex}")


def hand_over(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back, and its folder.

    Used by the iterative jobs: the result survives the loss of executors and the plan of
    the next round starts from files instead of from all earlier rounds.
    """
    path = work_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``hand_over`` for a table that stays, as results may be read from it."""
    return hand_over(df)[0]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that one of these jobs wrote, in whatever store it is."""
    if not os.path.basename(path.rstrip("/")).startswith(("cut-", "version=", "batch_id=", "upto=")):
        raise ValueError(f"{path} was not written by these jobs")
    store, folder = file_store(spark, path)
    store.delete(folder, True)


def file_store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders ``<name>=<number>`` in ``path``, ascending."""
    store, folder = file_store(spark, path)
    if not store.exists(folder):
        return []
    found = [s.getPath().getName() for s in store.listStatus(folder)]
    return sorted(int(x.partition("=")[2]) for x in found if x.startswith(f"{name}=") and store.exists(file_store(spark, f"{path}/{x}/_SUCCESS")[1]))
