"""Tables of what is in force per key, in a folder: Parquet runs by key-hash bucket, and a manifest that names the runs in force.

An upsert writes one run with the buckets its keys fall into and then, as its only visible step, a manifest. Where a bucket has gathered ``fan``
runs of a level they are merged into one of the next level, so a row is rewritten as often as levels grow, and buckets without
changes are not touched. A reader takes one manifest and reads what it names; runs stay until the last ``keep`` manifests are without them,
so upserts and merges don't disturb it. One writer at a time, as a stream's batch handler is.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.operators.latest import latest_by
from slotweave.session import file_store

BUCKET = "_bucket"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the manifests that a table at ``path`` still has, ascending."""
    store, folder = file_store(spark, f"{path}/manifests")
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest manifest or that of a version; ``None`` if there is none at all."""
    known = versions(spark, path)
    if version is None:
        if not known:
            return None
        version = known[-1]
    elif version not in known:
        raise ValueError(f"{path} has no version {version} any more, only {known}")
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifests/{version:012d}.json").collect()))


def commit_manifest(spark: SparkSession, path: str, version: int, held: dict) -> None:
    """Make a version the newest, in one step: the file gets its name when it is whole."""
    store, target = file_store(spark, f"{path}/manifests/{version:012d}.json")
    _, draft = file_store(spark, f"{path}/manifests/draft-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    if store.exists(target) or not store.rename(draft, target):
        raise RuntimeError(f"{target.toString()} is already there: two writers")


def drop_manifest(spark: SparkSession, path: str, version: int) -> None:
    store, file = file_store(spark, f"{path}/manifests/{version:012d}.json")
    store.delete(file, False)


@dataclass
class Manifest:
    """``runs`` maps each run to (level, its buckets in force); ``batch`` is the last batch that is in."""

    version: int = 0
    batch: int = -1
    buckets: int = 0
    runs: dict[str, tuple[int, list[int]]] = field(default_factory=dict)


class RunTable:
    """Runs of rows by ``keys``. ``reduced`` says what of some rows is in force; reduced parts reduced together give the whole's result."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64, fan: int = 8, keep: int = 10):
        if fan < 2 or keep < 1 or buckets < 1:
            raise ValueError("fan must be two or more, keep and buckets one or more")
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.buckets, self.fan, self.keep = buckets, fan, keep

    def reduced(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def sorting(self) -> list[Column]:
        """Order of rows in a file."""
        return [F.col(k) for k in self.keys]

    def options(self) -> dict[str, str]:
        """Of the Parquet writer."""
        return {}

    # --- manifests ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return versions(self.spark, self.path)

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one before the first upsert."""
        held = read_manifest(self.spark, self.path, version)
        if held is None:
            return Manifest(buckets=self.buckets)
        return Manifest(held["version"], held["batch"], held["buckets"], {k: (level, own) for k, (level, own) in held["runs"].items()})

    def _commit(self, m: Manifest) -> None:
        commit_manifest(self.spark, self.path, m.version, {"version": m.version, "batch": m.batch, "buckets": m.buckets, "runs": m.runs})

    # --- reading --------------------------------------------------------------------------------

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _folders(self, m: Manifest, only: set[int] | None = None) -> list[str]:
        return [f"{self.path}/runs/{run}/{BUCKET}={b}" for run, (_, own) in m.runs.items() for b in own if only is None or b in only]

    def read(self, version: int | None = None) -> DataFrame:
        """All current rows, as of now or of a version that is still kept."""
        return self.reduced(self._rows(self._folders(self.manifest(version))))

    def read_keys(self, *values) -> DataFrame:
        """The current row of one key: only its bucket's runs are opened."""
        m = self.manifest()
        typed = [F.lit(v).cast(self.schema[k].dataType).alias(k) for k, v in zip(self.keys, values, strict=True)]
        number = self.spark.range(1).select(*typed).select(self._bucket(m.buckets)).first()[0]
        rows = self._rows(self._folders(m, {number}))
        for k, v in zip(self.keys, values):
            rows = rows.filter(F.col(k).isNull() if v is None else F.col(k) == F.lit(v).cast(self.schema[k].dataType))
        return self.reduced(rows)

    def read_buckets_of(self, keys: DataFrame) -> DataFrame:
        """Current rows with a key in ``keys`` (the key columns, distinct): only their buckets' runs are opened."""
        m = self.manifest()
        touched = {r[0] for r in keys.select(self._bucket(m.buckets)).distinct().collect()}  # at most as many numbers as there are buckets
        mine = self._rows(self._folders(m, touched))
        renamed = keys.select(*[F.col(k).alias(f"_key_{k}") for k in self.keys])
        same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self.keys]
        return self.reduced(mine.join(renamed, same, "left_semi"))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int").alias(BUCKET)

    # --- writing --------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, batch: int | None = None) -> int:
        """Take in ``rows``; the version that has them. A ``batch`` that is in already changes nothing."""
        m = self.manifest()
        if batch is not None and batch <= m.batch:
            return m.version
        own = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        runs = dict(m.runs)
        run, buckets = self._write(self.reduced(own), m.buckets, m.version + 1, 0)
        if buckets:
            runs[run] = (0, buckets)
        level = 0
        while due := self._due(runs, level):
            merging = [r for r, (n, _) in runs.items() if n == level]
            folders = [f"{self.path}/runs/{r}/{BUCKET}={b}" for r in merging for b in runs[r][1] if b in due]
            run, buckets = self._write(self.reduced(self._rows(folders)), m.buckets, m.version + 1, level + 1)
            runs = {r: (n, [b for b in held if r not in merging or b not in due]) for r, (n, held) in runs.items()}
            runs = {r: (n, held) for r, (n, held) in runs.items() if held} | {run: (level + 1, buckets)}
            level += 1
        new = Manifest(m.version + 1, m.batch if batch is None else batch, m.buckets, runs)
        self._commit(new)
        self._clean()
        return new.version

    def _due(self, runs: dict[str, tuple[int, list[int]]], level: int) -> set[int]:
        """Buckets that have gathered ``fan`` runs of a level."""
        count: dict[int, int] = {}
        for n, own in runs.values():
            for b in own if n == level else ():
                count[b] = count.get(b, 0) + 1
        return {b for b, n in count.items() if n >= self.fan}

    def _write(self, rows: DataFrame, buckets: int, version: int, level: int) -> tuple[str, list[int]]:
        run = f"{version:012d}-{level}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/runs/{run}"
        dealt = rows.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.sorting())
        dealt.write.options(**self.options()).partitionBy(BUCKET).parquet(path)
        store, folder = file_store(self.spark, path)
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return run, sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{BUCKET}="))

    def _clean(self) -> None:
        """Manifests before the last ``keep`` go, and runs that none of those names."""
        versions = self.versions()
        kept = versions[-self.keep :]
        store, folder = file_store(self.spark, f"{self.path}/runs")
        old = versions[: -self.keep]
        if not old:
            return
        named = {run for v in kept for run in self.manifest(v).runs}
        for v in old:
            drop_manifest(self.spark, self.path, v)
        for s in store.listStatus(folder):
            if s.getPath().getName() not in named:
                store.delete(s.getPath(), True)


class KeyedTable(RunTable):
    """Current rows: of equal keys the row with the greatest ``order``, of equal ones any."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 64, fan: int = 8, keep: int = 10):
        super().__init__(spark, path, schema, keys, buckets, fan, keep)
        self.order = order

    def reduced(self, rows: DataFrame) -> DataFrame:
        return latest_by(rows, self.keys, F.struct(*self.order))
