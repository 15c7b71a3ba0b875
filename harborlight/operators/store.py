"""Tables on plain Parquet: upsert, retire and replace as pure functions, and a versioned directory with a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CVE_PATTERN


def upsert(store: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The new state of a table, with ``created``: rows of the batch replace rows of the same key, the last by ``order`` wins.

    Null key fields match each other. ``created`` is true for keys the store did not have and null for rows left alone.
    """
    rest = [c for c in store.columns if c not in key]
    newest = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("n"))
    a, b = store.select(*key, F.struct(*rest).alias("o")).alias("a"), newest.alias("b")
    same = None
    for k in key:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = one if same is None else same & one
    both = a.join(b, same, "full")
    value = F.coalesce("n", "o")
    created = F.when(F.col("n").isNotNull(), F.col("o").isNull())
    picked = [F.when(F.col("o").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in key]
    return both.select(*picked, value.alias("v"), created.alias("created")).select(*key, *[F.col(f"v.{c}").alias(c) for c in rest], "created").select(*store.columns, "created")


def retire(store: DataFrame, keep: DataFrame, key: list[str], scope: list[str]) -> DataFrame:
    """``store`` with is_current false for current rows that ``keep`` lacks, within the scopes (say, assets) it names."""
    kept = keep.select(*key).distinct().withColumn("kept", F.lit(True))
    covered = keep.select(*scope).distinct().withColumn("covered", F.lit(True))
    rows = store.join(kept, key, "left").join(covered, scope, "left")
    gone = F.col("covered").isNotNull() & F.col("kept").isNull()
    return rows.withColumn("is_current", F.col("is_current") & ~gone).select(*store.columns)


def stale_queries(queries: DataFrame, as_of: Column, ttl_hours: int) -> DataFrame:
    """Cached queries (cpe, fetched_at, ...) with ``fresh``; an empty answer is cached like any other."""
    return queries.withColumn("fresh", as_of - F.col("fetched_at") < F.make_dt_interval(hours=F.lit(ttl_hours)))


class VersionedTable:
    """A table as one directory per version and one small manifest file per version that names its directory.

    The manifest is written aside and renamed into place after the data, and none is ever changed or removed before a later
    one is there: readers take the greatest number and see the old or the new version, never a mixture or nothing, whenever a
    writer dies. Of two writers of one version the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by
        self._fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._p("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(""))]
        return sorted(int(n.rsplit(".", 1)[1]) for n in names if n.startswith("_manifest."))

    def _directory(self, version: int) -> str:
        stream = self._fs.open(self._p(f"_manifest.{version}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        """The number of the current version, 0 if there is none."""
        return max(self._versions(), default=0)

    def read(self) -> DataFrame:
        if not (v := self.version()):
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{self._directory(v)}")

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.partitionBy(*self.partition_by).parquet(path)

    def replace(self, df: DataFrame) -> int:
        """Write the next version and make it current. ``df`` may read the current one."""
        v = self.version() + 1
        directory = f"v{v}-{uuid.uuid4().hex}"
        self._write(df, f"{self.path}/{directory}")
        aside, final = self._p(f"_new.{directory}"), self._p(f"_manifest.{v}")
        out = self._fs.create(aside, False)
        out.write(bytearray(directory.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise FileExistsError(f"version {v} of {self.path} was written by another writer")
        return v

    def vacuum(self, keep: int = 1) -> None:
        """Remove all versions but the last ``keep``; nothing may read them any more."""
        for v in self._versions()[:-keep]:
            data = self._p(self._directory(v))
            self._fs.delete(self._p(f"_manifest.{v}"), False)
            self._fs.delete(data, True)


class AppendOnlyTable:
    """A log: rows can be added and read, nothing else."""

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path, partition_by

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").partitionBy(*self.partition_by).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def cached_records(queries: DataFrame, records: DataFrame, as_of: Column, ttl_hours: int) -> DataFrame:
    """What the cache answers to its fresh queries (cpe, cve_ids, fetched_at): (cpe, cve_id and the record's columns)."""
    fresh = stale_queries(queries, as_of, ttl_hours).filter("fresh").select("cpe", F.explode(F.array_distinct("cve_ids")).alias("cve_id"))
    return fresh.join(records, "cve_id").select("cpe", *records.columns)


def lookup(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """One row per wanted id (asked): ``cve_id`` in its standard form (null if it is no id), whether it is ``cached``, and the
    record's other columns. An id does not go stale: it has no time to live."""
    standard = F.upper(F.btrim("asked"))
    rows = wanted.select("asked", F.when(standard.rlike(CVE_PATTERN), standard).alias("cve_id"))
    held = records.withColumn("cached", F.lit(True))
    rest = [c for c in records.columns if c != "cve_id"]
    return rows.join(held, "cve_id", "left").select("asked", "cve_id", F.coalesce("cached", F.lit(False)).alias("cached"), *rest)
