"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only in local mode (tests) one is set here where the session names none: a folder of one machine would hide an executor's
    files from all others, so a cluster without a shared one is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir("/tmp/harborlight-checkpoints")
        base = sc._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/hl-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors.

    The files go when the driver ends, as results may read them until then; :func:`discard` frees them before.
    """
    return stored_in_turns([df])


def stored_in_turns(parts: Iterable[DataFrame]) -> DataFrame:
    """As :func:`stored`, for the rows of all parts: one is made and written after the other."""
    path = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = shared_dir(spark)
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
        df.write.mode("append").parquet(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def stored_in_buckets(parts: Iterable[DataFrame], n: int, *keys: str) -> DataFrame:
    """As :func:`stored_in_turns`, dealt over ``n`` buckets by ``keys``: see :func:`joined_in_buckets`.

    Only Spark's catalog can write buckets; the table leaves it at once, its files stay.
    """
    path = None
    for df in parts:
        if path is None:
            spark, path, name = df.sparkSession, shared_dir(df.sparkSession), f"hl_{uuid.uuid4().hex}"
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
        df.repartition(n, *keys).write.format("parquet").mode("append").option("path", path).bucketBy(n, *keys).saveAsTable(name)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out._stored_at = path
    return out


def joined_in_buckets(df: DataFrame) -> DataFrame:
    """``df``, whose joins by the keys of :func:`stored_in_buckets` and more are planned without moving rows.

    Spark moves them unless a setting is off that guards others' joins against hot keys, so it is off in a copy of the session, which only
    ``df`` and what is derived from it use. A temporary view of it would be in that copy too.
    """
    own = df.sparkSession._jsparkSession.cloneSession()
    own.conf().set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return DataFrame(df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.queryExecution().analyzed()), df.sparkSession)


def discard(df: DataFrame) -> None:
    """Free what :func:`stored` wrote, once nothing reads it any more."""
    if path := df.__dict__.get("_stored_at"):
        there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of every job started in here go when it ends; else they stay until the driver happens to collect garbage.

    For chains of :func:`stored` tables, where no later job reads the shuffles of an earlier one.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
