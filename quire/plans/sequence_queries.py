"""Queries over ordered rows: sessions, intervals, islands, states, look-ahead, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import sequence as S
from quire.plans.registry import query
from quire.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, ts, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cluster_id FROM g)
SELECT user_id, cluster_id, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM c GROUP BY ALL"""
)
def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events at most six hours apart."""
    runs = S.sessions(_events(spark, sf_dir), ["user_id"], "ts", 6 * 3600, "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return runs.groupBy("user_id", "cluster_id").agg(F.count("*").alias("n"), F.min(us).alias("start_us"), F.max(us).alias("end_us"))


@query(
    """WITH i AS (SELECT user_id, epoch_us(ts) AS lo, epoch_us(ts) + CAST(floor(abs(value)) AS BIGINT) * 60000000 AS hi FROM events),
f AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
c AS (SELECT *, sum(CASE WHEN m IS NULL OR lo > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS c FROM f)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM c GROUP BY user_id, c"""
)
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of the minutes that a user's events last."""
    lo = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf_dir).select("user_id", lo.alias("lo"), (lo + F.floor(F.abs("value")).cast("bigint") * 60000000).alias("hi"))
    return S.merged_intervals(rows, ["user_id"], "lo", "hi")


@query(
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS start_date, coalesce(CAST(lead(o_orderdate) OVER w AS DATE) - 1, DATE '1999-12-31') AS end_date
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def next_range_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long an order is a customer's latest: until the day before the next."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("start_date"))
    out = S.range_ends(rows, ["o_custkey"], "start_date", ["o_orderdate", "o_orderkey"], F.to_date(F.lit("1999-12-31")), name="end_date")
    return out.select("o_orderkey", "o_custkey", "start_date", "end_date")


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marker,
last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marker_before FROM events"""
)
def asof_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's latest purchase at or before each event, and before it."""
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    at = S.as_of(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], mark, "marker")
    return S.as_of(at, ["user_id"], ["ts", "event_id"], mark, "marker_before", strict=True).select("event_id", "user_id", "marker", "marker_before")


@query(
    """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'none') AS state FROM events"""
)
def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the last switching event of a user set."""
    switch = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    out = S.as_of(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], switch, "state")
    return out.select("event_id", "user_id", F.coalesce("state", F.lit("none")).alias("state"))


_DAYS = "d AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d), i AS (SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, g)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.to_date(F.lit("2024-01-01"))).cast("bigint")
    return S.islands(_events(spark, sf_dir).select("user_id", day.alias("day")), ["user_id"], "day")


@query(f"WITH {_DAYS} SELECT * FROM i")
def day_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive active days."""
    return _days(spark, sf_dir)


@query(f"WITH {_DAYS} SELECT user_id, string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE first || '-' || last END, ', ' ORDER BY first) AS ranges FROM i GROUP BY user_id")
def run_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's active days as "1-4, 7, 9-10"."""
    return S.run_text(_days(spark, sf_dir), ["user_id"])


@query(
    """SELECT event_id, user_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS next_purchase FROM events"""
)
def lookahead_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next purchase within eight events."""
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return S.look_ahead(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], mark, 8, "next_purchase").select("event_id", "user_id", "next_purchase")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY l_returnflag) // 20) AS step, l_returnflag FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE i % step = 0"""
)
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step-th line item of a flag, about twenty of each: the operator is a sample."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return S.stride(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 20)


@query(
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT o_custkey, n, greatest(1, n // 5) AS k FROM n)
SELECT o_custkey, i AS segment, i * n // k AS lo, (i + 1) * n // k AS hi FROM (SELECT o_custkey, n, k, unnest(range(k)) AS i FROM k)"""
)
def equal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in segments of about five, of equal width in whole numbers."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("k", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / 5)))
    each = n.withColumn("segment", F.explode(F.expr("sequence(0L, k - 1)")))
    cut = lambda i: F.floor(i * F.col("n") / F.col("k")).cast("bigint")
    return each.select("o_custkey", "segment", cut(F.col("segment")).alias("lo"), cut(F.col("segment") + 1).alias("hi"))


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 2 AS batch FROM orders")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in requests of two."""
    return S.batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2)


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n != event_type"""
)
def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's adjacent events of one type, the last."""
    return S.without_repeats(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query(
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS e FROM events)
SELECT user_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM r WHERE h > 1 AND e > 1 GROUP BY user_id"""
)
def trimmed_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of a user's values without the first and the last event (a page without header and footer)."""
    head = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    tail = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = _events(spark, sf_dir).withColumn("h", head).withColumn("e", tail).where("h > 1 AND e > 1")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
