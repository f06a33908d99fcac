"""Keyed tables fed by changes, and the ring of the newest events: append-only folders, merged when they are read.

A change log holds ``log/batch=N`` folders of changes (``key``, ``version``, ``deleted``, and the row's columns) and
``base-N`` folders, each the state after batch N. Reading takes the newest whole base and the batches after it; of each
key the change of the highest version counts, wherever and however late it arrived, and a tombstone hides its key.
Batches are written under their number, so a batch that is replayed replaces itself. Compaction writes the next base
and then removes what it covers; tombstones stay in it until ``forget`` (a version), since older changes may still come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that holds a few of them; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def _whole(spark: SparkSession, folder: str) -> bool:
    return "_SUCCESS" in _names(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in _names(spark, folder) if n.startswith(prefix) and _whole(spark, f"{folder}/{n}"))


def latest(changes: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The change of the highest version of each key; of equal versions the greater row, so that reruns agree."""
    rest = [c for c in changes.columns if c not in (key, version)]
    newest = changes.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("_row"))
    return newest.select(key, "_row.*").select(changes.columns)


class ChangeLog:
    """A keyed table below ``folder``. ``schema`` has key, version (long) and deleted (boolean) among its columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def append(self, changes: DataFrame, batch: int) -> None:
        """Write the changes of a batch, one for each key; as ``foreachBatch`` function."""
        latest(changes).write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")

    def _parts(self) -> tuple[int, list[int]]:
        bases = _numbers(self.spark, self.folder, "base-")
        base = bases[-1] if bases else -1
        return base, [n for n in _numbers(self.spark, f"{self.folder}/log", "batch=") if n > base]

    def changes(self) -> DataFrame:
        """The newest change of each key, tombstones too."""
        base, batches = self._parts()
        paths = [f"{self.folder}/log/batch={n}" for n in batches] + ([f"{self.folder}/base-{base}"] if base >= 0 else [])
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return latest(self.spark.read.schema(self.schema).parquet(*paths))

    def read(self, cap: int | None = None) -> DataFrame:
        """The rows as of now; with ``cap``, those of the highest versions (ties: the smaller key)."""
        rows = self.changes().where(~F.coalesce("deleted", F.lit(False)))
        return rows if cap is None else rows.orderBy(F.col("version").desc(), "key").limit(cap)

    def compact(self, forget: int | None = None) -> None:
        """Write the next base and remove what it covers; tombstones of a version below ``forget`` are dropped."""
        base, batches = self._parts()
        if not batches:
            return
        rows = self.changes()
        if forget is not None:
            rows = rows.where(~F.coalesce("deleted", F.lit(False)) | (F.col("version") >= forget))
        rows.write.mode("overwrite").parquet(f"{self.folder}/base-{batches[-1]}")
        for n in batches:
            _remove(self.spark, f"{self.folder}/log/batch={n}")
        if base >= 0:
            _remove(self.spark, f"{self.folder}/base-{base}")


class Ring:
    """The last ``size`` events by ``order``, below ``folder``.

    A batch's tasks give their newest ``size`` rows, which are merged with the ring of the batch before; the state has
    ``size`` rows at most. A replayed batch starts from the same ring again. The two newest rings are kept.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, order: list[Column], size: int = 500):
        self.spark, self.folder, self.schema, self.order, self.size = spark, folder.rstrip("/"), schema, order, size

    def append(self, events: DataFrame, batch: int) -> None:
        """Take in a batch; as ``foreachBatch`` function."""
        before = [n for n in _numbers(self.spark, self.folder, "ring-") if n < batch]
        rows = events if not before else events.unionByName(self._ring(before[-1]))
        rows.orderBy(*self.order).limit(self.size).write.mode("overwrite").parquet(f"{self.folder}/ring-{batch}")
        for n in before[:-1]:
            _remove(self.spark, f"{self.folder}/ring-{n}")

    def _ring(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/ring-{n}")

    def read(self, limit: int | None = None) -> DataFrame:
        """The newest events first."""
        have = _numbers(self.spark, self.folder, "ring-")
        rows = self._ring(have[-1]).orderBy(*self.order) if have else self.spark.createDataFrame([], self.schema)
        return rows if limit is None else rows.limit(limit)
