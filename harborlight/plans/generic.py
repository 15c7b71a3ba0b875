"""Relational breadth over the base tables: joins, aggregates, windows, set operations, nested values, time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import temporal
from .fixtures import spark_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def both(name: str, sql: str, spark: str | None = None) -> None:
    """The same SQL for Spark (``@table@`` for tables) and the oracle, or a dialect of it for Spark."""
    import re

    text = spark or sql
    QUERIES[name] = lambda s, d, text=text: spark_sql(s, d, text)
    ORACLES[name] = re.sub(r"@(\w+)@", r"\1", sql)


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


both("join_inner", "SELECT c_custkey, n_name, r_name FROM @customer@ JOIN @nation@ ON c_nationkey = n_nationkey JOIN @region@ ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
both("join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM @customer@ LEFT JOIN @orders@ ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
both("join_right", "SELECT s_suppkey, c_custkey FROM @customer@ RIGHT JOIN @supplier@ ON c_custkey = s_suppkey * 3")
both("join_full", "SELECT coalesce(c_custkey, -1) AS c, coalesce(s_suppkey, -1) AS s FROM (SELECT c_custkey FROM @customer@ WHERE c_custkey < 300) a FULL JOIN @supplier@ ON c_custkey = s_suppkey * 7")
both("join_semi", "SELECT o_orderkey FROM @orders@ WHERE EXISTS (SELECT 1 FROM @lineitem@ WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
both("join_anti", "SELECT c_custkey FROM @customer@ WHERE NOT EXISTS (SELECT 1 FROM @orders@ WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
both("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM @lineitem@ WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
both("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM @customer@ JOIN @orders@ ON c_custkey = o_custkey JOIN @lineitem@ ON l_orderkey = o_orderkey
  JOIN @supplier@ ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN @nation@ ON s_nationkey = n_nationkey GROUP BY n_name""")
both("group_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM @lineitem@ GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("group_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM @orders@ GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("group_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM @customer@ GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
both("count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts FROM @lineitem@ GROUP BY l_returnflag")
both("having_filter", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f FROM @orders@ GROUP BY o_custkey HAVING count(*) > 12")
both("percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(stddev_samp(l_quantity), 6) AS sd FROM @lineitem@ GROUP BY l_returnflag",
     "SELECT l_returnflag, round(percentile(l_extendedprice, 0.5), 4) AS p50, round(percentile(l_extendedprice, 0.9), 4) AS p90, round(stddev_samp(l_quantity), 6) AS sd FROM @lineitem@ GROUP BY l_returnflag")
both("window_ranks", """SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nt
  FROM @orders@ WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
both("window_offsets", """SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(value) OVER w AS first_v, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v
  FROM @events@ WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
both("window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving FROM @events@")
both("window_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM @orders@")
both("top_k_per_group", "SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM @customer@) x WHERE rn <= 3")
both("top_k_global", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM @lineitem@ ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
both("set_union", "SELECT c_nationkey AS k FROM @customer@ UNION SELECT s_nationkey FROM @supplier@")
both("set_union_all", "SELECT c_nationkey AS k FROM @customer@ UNION ALL SELECT s_nationkey FROM @supplier@")
both("set_intersect", "SELECT c_nationkey AS k FROM @customer@ INTERSECT SELECT s_nationkey FROM @supplier@")
both("set_intersect_all", "SELECT c_nationkey AS k FROM @customer@ INTERSECT ALL SELECT s_nationkey FROM @supplier@")
both("set_except", "SELECT n_nationkey AS k FROM @nation@ EXCEPT SELECT s_nationkey FROM @supplier@ WHERE s_suppkey < 12")
both("set_except_all", "SELECT c_nationkey AS k FROM @customer@ EXCEPT ALL SELECT s_nationkey FROM @supplier@")
both("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM @events@", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM @events@")
both("explode_words", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM @part@) GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT explode(split(lower(p_type), ' ')) AS word FROM @part@) GROUP BY word")
both("array_agg_sorted", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM @orders@ GROUP BY o_custkey", "SELECT o_custkey, array_sort(collect_list(o_orderkey)) AS keys FROM @orders@ GROUP BY o_custkey")
both("map_lookup", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 END AS code FROM @customer@", "SELECT c_custkey, try_element_at(map('AUTOMOBILE', 1, 'BUILDING', 2), c_mktsegment) AS code FROM @customer@")
both("date_parts", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y FROM @orders@",
     "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS days, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y FROM @orders@")
both("regex_extract", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare FROM @part@", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '') AS bare FROM @part@")
both("pivot_status", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM @orders@ GROUP BY o_orderpriority",
     "SELECT o_orderpriority, coalesce(F, 0) AS f, coalesce(O, 0) AS o, coalesce(P, 0) AS p FROM (SELECT o_orderpriority, o_orderstatus FROM @orders@) PIVOT (count(*) FOR o_orderstatus IN ('F' AS F, 'O' AS O, 'P' AS P))")
both("recursive_hierarchy", "WITH RECURSIVE t AS (SELECT CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS depth UNION ALL SELECT n * 2, depth + 1 FROM t WHERE depth < 10) SELECT n, depth, n_name FROM t JOIN @nation@ ON n % 25 = n_nationkey")
both("scalar_subquery", "SELECT s_suppkey, round(s_acctbal - (SELECT avg(s_acctbal) FROM @supplier@), 6) AS above FROM @supplier@")
both("quantified_in", "SELECT p_partkey FROM @part@ WHERE p_partkey IN (SELECT l_partkey FROM @lineitem@ WHERE l_discount > 0.09)")


@register("approx_distinct")
def approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n_parts"))


@register("asof_order", """SELECT e.event_id, o.o_orderkey AS last_order, o.o_totalprice AS last_price FROM events e ASOF LEFT JOIN
  (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_order(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").alias("at"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"))
    return temporal.asof_join(e, o, "k", "at", ["last_order", "last_price"], segment="date_trunc('YEAR', at)").select("event_id", "last_order", "last_price")


@register("interval_join", "SELECT a.event_id, b.event_id AS opener FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts < b.ts + INTERVAL 6 HOUR")
def interval_join(spark, d):
    e = table(spark, d, "events")
    openers = e.select("user_id", F.col("event_id").alias("opener"), F.col("ts").alias("begins"), (F.col("ts") + F.expr("interval 6 hours")).alias("ends"))
    return temporal.interval_join(e.select("event_id", "user_id", "ts"), openers, "user_id", "ts", "begins", "ends", 6 * 3600).select("event_id", "opener")


@register("range_join", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN part ON p_retailprice BETWEEN 900 + s_suppkey % 90 AND 900 + s_suppkey % 90 + 1.5 GROUP BY s_suppkey")
def range_join(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.lit(900) + F.col("s_suppkey") % 90).cast("double").alias("low")).withColumn("high", F.col("low") + 1.5)
    return temporal.range_join(table(spark, d, "part").select("p_retailprice"), s, "p_retailprice", "low", "high", 2.0).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@register("tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return temporal.windowed_counts(table(spark, d, "events"), "ts", "1 day", None, ["event_type"], F.col("value")).withColumn("total", F.round("total", 4))


@register("sliding_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) t(k) GROUP BY ALL")
def sliding_window(spark, d):
    return temporal.windowed_counts(table(spark, d, "events"), "ts", "12 hours", "6 hours", [], F.col("value")).withColumn("total", F.round("total", 4))


@register("session_window", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_window(spark, d):
    return temporal.sessions(table(spark, d, "events"), "user_id", "ts", "2 hours")


@register("lateral_top", "SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x")
def lateral_top(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))
    return table(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@register("salted_count", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def salted_count(spark, d):
    """Few hot keys: distinct users per (key, user) first, map-side combined, then counts per key."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return e.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("users"))


@register("running_share", "SELECT p_brand, n, sum(n) OVER (ORDER BY n DESC, p_brand) AS upto FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def running_share(spark, d):
    per = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))  # a row per brand
    return per.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("n").desc(), "p_brand")))
