"""Streams over the base tables, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.store import VersionedTable
from ..storage import shared_dir
from ..streaming import jobs
from .domain import _SCAN
from .fixtures import spark_sql, view

QUERIES: dict = {}
ORACLES: dict = {}


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream over all data there is, by way of the shared folder; in complete mode the last version of it."""
    spark, out = stream.sparkSession, shared_dir(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}-state")
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    table = VersionedTable(spark, out)
    writer.foreachBatch(lambda rows, _: table.replace(rows)).start().awaitTermination()
    return table.read()


def source(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A stream over the rows of a table, written to a folder the stream watches."""
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            from .fixtures import oracle

            ORACLES[name] = oracle(sql)
        return fn

    return add


@register("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    s = source(spark, spark_sql(spark, d, "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM @events@"))
    return drained(jobs.windowed_counts(s, "ts", "1 day", None, ["event_type"], F.col("value"), "400 days"), "complete").withColumn("total", F.round("total", 4))


@register("stream_dedup", "SELECT tenant_id, CAST(run_id AS VARCHAR) AS run_id, observation_type, count(*) AS n FROM (SELECT DISTINCT tenant_id, run_id, coalesce(source_identifier, '') AS sid, observation_type, payload FROM v_observation) GROUP BY ALL")
def stream_dedup(spark, d):
    s = source(spark, view(spark, d, "v_observation"))
    return drained(jobs.distinct_observations(s, late="4000 days")).groupBy("tenant_id", F.col("run_id").cast("string").alias("run_id"), "observation_type").agg(F.count("*").alias("n"))


@register("stream_breaker", f"WITH {_SCAN} SELECT CAST(run_id AS VARCHAR) AS run_id, pos, outcome, CAST(streak AS BIGINT) AS streak, halted_at IS NULL OR pos <= halted_at AS reached FROM h")
def stream_breaker(spark, d):
    rows = scan.scan_outcome(view(spark, d, "v_scan_event")).select(F.col("run_id").cast("string").alias("run_id"), "pos", "outcome").coalesce(1)
    return drained(jobs.breaker_stream(source(spark, rows)))
