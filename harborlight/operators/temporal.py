"""Joins on time and ranges that Spark has no operator for, and windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], segment: str | None = None) -> DataFrame:
    """Each left row with the ``values`` of the last right row of the same ``by`` at or before its time ``at``.

    One union and one running window instead of a range join: rows of both sides lie together by key and time, and the last
    right row is carried along. Ties: right rows at the same time count as before, the greatest by their values wins.
    ``segment`` (say, a month, as SQL over ``at``) splits hot keys: each segment starts from the last row carried out of the
    segments before it, found by a second window over one row per key and segment.
    """
    packed = F.struct(*[F.col(v) for v in values])
    l = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("__p"))
    rest = [c for c in left.columns if c not in (by, at)]
    r = right.select(F.col(by), F.col(at), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], F.lit(0).alias("__side"), packed.alias("__p"))
    both = l.select(by, at, *rest, "__side", "__p").unionByName(r)
    both = both.withColumn("__seg", F.expr(segment) if segment else F.lit(0))
    run = Window.partitionBy(by, "__seg").orderBy(at, "__side", "__p").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__v", F.last("__p", ignorenulls=True).over(run))
    if segment:
        ends = both.groupBy(by, "__seg").agg(F.max_by("__p", F.when(F.col("__p").isNotNull(), F.struct(at, "__p"))).alias("__end"))
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy(by).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1))
        carried = carried.join(ends.withColumn("__start", before).select(by, "__seg", "__start"), [by, "__seg"]).withColumn("__v", F.coalesce("__v", "__start"))
    return carried.filter("__side = 1").select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def _dealt(left: DataFrame, right: DataFrame, value: Column, low: Column, high: Column, width: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__level`` and ``__b``, on which they meet: a right row has two buckets or so, however long its range is.

    Buckets of level n are ``width * 2**n`` wide, and a range goes to the level whose buckets are as wide as it is long. A left row
    goes to its bucket on every level that some range is on (one row, of 64 numbers at most, tells which).
    """
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    ranges = right.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((high - low).cast("double"), F.lit(float(width))) / width))).cast("int"))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(low / size(F.col("__level"))), F.floor(high / size(F.col("__level"))))))
    used = F.broadcast(ranges.agg(F.collect_set("__level").alias("__levels")))  # one row
    l = left.join(used).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__b", F.floor(value / size(F.col("__level"))))
    return l, r


def interval_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_from: str, right_to: str, bucket_seconds: int) -> DataFrame:
    """Left rows inside the right rows' intervals [from, to) of the same key.

    An equi-join on key and buckets of time (of ``bucket_seconds`` and its doubles, see :func:`_dealt`), so only neighbours are compared.
    """
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    l, r = _dealt(left, right.filter(F.col(right_from) < F.col(right_to)), sec(left_at), sec(right_from), sec(right_to), bucket_seconds)
    return l.join(r, [by, "__level", "__b"]).filter((F.col(left_at) >= F.col(right_from)) & (F.col(left_at) < F.col(right_to))).drop("__level", "__b")


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Left rows whose ``value`` lies in [low, high] of a right row, by equi-join on buckets of ``width`` and its doubles."""
    l, r = _dealt(left, right.filter(F.col(low) <= F.col(high)), F.col(value), F.col(low), F.col(high), width)
    return l.join(r, ["__level", "__b"]).filter(F.col(value).between(F.col(low), F.col(high))).drop("__level", "__b")


def sessions(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """(by, session_start, session_end, n): runs of events less than ``gap`` apart."""
    w = F.session_window(at, gap)
    return events.groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def windowed_counts(events: DataFrame, at: str, size: str, slide: str | None, keys: list[str], value: Column) -> DataFrame:
    """Counts and sums per tumbling (no slide) or sliding window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def spaced(requests: DataFrame, by: list[str], at: str, order: list[str], seconds: float) -> DataFrame:
    """Adds ``starts`` to requests: when each may go out if two of one ``by`` are at least ``seconds`` apart.

    A request waits for those before it, so the start of request i is the latest of ``at`` of j plus (i - j) spacings over all
    j up to i: one running maximum.
    """
    line = Window.partitionBy(*by).orderBy(at, *order)
    rows = requests.withColumn("__i", F.row_number().over(line)).withColumn("__s", F.unix_micros(at) - F.col("__i") * int(seconds * 1e6))
    ahead = F.max("__s").over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i") * int(seconds * 1e6)
    return rows.withColumn("starts", F.timestamp_micros(ahead)).drop("__i", "__s")
