"""Queries for join shapes, votes and grouped decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import joins as J
from quire.operators import votes as V
from quire.operators.detect import outline_rows
from quire.plans.registry import query
from quire.session import table


@query(
    """WITH a AS (SELECT c_nationkey AS nation, count(*) AS a_value FROM customer WHERE c_nationkey % 5 != 0 GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS b_value FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(a.nation, b.nation) AS nation, a_value, coalesce(b_value, 0) AS b_value, CASE WHEN b_value IS NULL THEN 'missing_in_b' WHEN a_value IS NULL THEN 'only_in_b' ELSE 'both' END AS status FROM a FULL JOIN b ON a.nation = b.nation"""
)
def chapter_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_nationkey % 5 != 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return J.full_outer_report(a, b, "nation", "n")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_custkey % 3 != 0)")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_custkey % 3 != 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@query("SELECT o_orderkey, o_totalprice, coalesce(n, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def left_outer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(lines, "o_orderkey", "left").select("o_orderkey", "o_totalprice", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(
    """WITH k AS (SELECT DISTINCT p_brand AS key FROM part UNION SELECT DISTINCT p_brand || '.png' FROM part WHERE p_size > 45), r AS (SELECT p_partkey, p_name, p_brand, p_size FROM part),
c AS (SELECT p_partkey, 0 AS p, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'figures/' || p_brand END AS key FROM r UNION ALL SELECT p_partkey, 1, p_brand || '.png' FROM r)
SELECT p_partkey, arg_min(key, p) AS matched, min(p) AS priority FROM c JOIN k USING (key) GROUP BY p_partkey"""
)
def candidate_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths matched as written, else with an extension."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_brand").alias("key")).unionByName(part.where("p_size > 45").select(F.concat("p_brand", F.lit(".png")).alias("key")))
    written = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("figures/"), "p_brand"))
    return J.first_candidate(part, "p_partkey", [written, F.concat("p_brand", F.lit(".png"))], known, "key")


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey AS k, epoch(o_orderdate) // 86400 AS lo, epoch(o_orderdate) // 86400 + 30 AS hi FROM orders)
SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key, CAST(least(a.hi, b.hi) - greatest(a.lo, b.lo) AS BIGINT) AS overlap FROM a JOIN a b ON a.k = b.k AND a.lo < b.hi AND b.lo < a.hi AND a.o_orderkey < b.o_orderkey"""
)
def interval_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a customer's orders share, each lasting 30."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), day.alias("lo"), (day + 30).alias("hi"))
    met = J.interval_overlaps(rows.withColumnRenamed("o_orderkey", "a_key"), rows.withColumnRenamed("o_orderkey", "b_key"), "k", 30)
    return met.where("a_key < b_key").select("a_key", "b_key", "overlap")


@query(
    """WITH r(title, lo, hi) AS (VALUES ('small', 1, 10), ('medium', 8, 30), ('large', 31, 50))
SELECT title, count(*) AS n, min(p_partkey) AS first_part FROM part JOIN r ON p_size BETWEEN lo AND hi GROUP BY title"""
)
def range_expand_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in named, inclusive, overlapping ranges."""
    ranges = spark.createDataFrame([("small", 1, 10), ("medium", 8, 30), ("large", 31, 50)], "title string, lo int, hi int")
    sizes = J.range_expand(ranges, "lo", "hi", "p_size").select("title", "p_size")
    return table(spark, sf_dir, "part").join(F.broadcast(sizes), "p_size").groupBy("title").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 10) <= abs(l_quantity - 25) AND abs(l_quantity - 10) <= abs(l_quantity - 50) THEN 10.0 WHEN abs(l_quantity - 25) <= abs(l_quantity - 50) THEN 25.0 ELSE 50.0 END::DOUBLE AS snapped FROM lineitem"""
)
def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", J.snapped(F.col("l_quantity"), [10.0, 25.0, 50.0]).alias("snapped"))


@query(
    """WITH p AS (SELECT p_partkey, left(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), CAST(2 + p_partkey % 7 AS INT)) AS k FROM part), q AS (SELECT k, min(p_partkey) AS first FROM p WHERE length(k) >= 3 GROUP BY k)
SELECT x.p_partkey, min(q.first) AS matched FROM p x JOIN q ON starts_with(x.k, q.k) OR starts_with(q.k, x.k) WHERE length(x.k) >= 3 GROUP BY x.p_partkey"""
)
def prefix_theta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cut to 3 to 8 letters and digits, one of which begins the other; the first by key wins."""
    key = F.expr("left(regexp_replace(upper(p_name), '[^A-Z0-9]', ''), cast(2 + p_partkey % 7 AS int))")
    names = table(spark, sf_dir, "part").select("p_partkey", key.alias("k")).where(F.length("k") >= 3)
    return J.nested_prefixes(names, names, "p_partkey", "k", 3)


@query(
    """WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier)
SELECT k, pos, c_custkey, s_suppkey FROM a JOIN b USING (k, pos)"""
)
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return J.zipped(a, b, ["c_custkey"], ["s_suppkey"], ["k"])


@query(
    """WITH RECURSIVE t AS (SELECT 'world' AS node, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
w AS (SELECT node, parent, 0 AS depth, node AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, w.depth + 1, w.path || '/' || t.node FROM t JOIN w ON t.parent = w.node)
SELECT node, CAST(depth AS INT) AS depth, path FROM w"""
)
def outline_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline tree walked from its root, with paths that sort in pre-order."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = spark.sql("SELECT 'world' AS node, CAST(NULL AS string) AS parent")
    rows = rows.union(table(spark, sf_dir, "region").select(node("r", "r_regionkey"), F.lit("world")))
    rows = rows.union(table(spark, sf_dir, "nation").select(node("n", "n_nationkey"), node("r", "n_regionkey")))
    rows = rows.union(table(spark, sf_dir, "supplier").select(node("s", "s_suppkey"), node("n", "s_nationkey")))
    return outline_rows(rows, None)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each key of the log."""
    out = J.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])
    return out.select("user_id", F.col("event_type").alias("status"), "event_id")


@query(
    """SELECT event_id, user_id, event_type FROM events WHERE CAST(ts AS DATE) != DATE '2024-01-05' UNION ALL SELECT event_id, user_id, 'replaced' FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' AND value > 0"""
)
def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's rows replaced by a new version of them."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    new = events.where("day = date '2024-01-05' AND value > 0").withColumn("event_type", F.lit("replaced"))
    kept = events.join(F.broadcast(spark.sql("SELECT date '2024-01-05' AS day")), "day", "left_anti")
    return kept.unionByName(new).select("event_id", "user_id", "event_type")


@query("SELECT l_returnflag, l_linestatus, median(l_quantity) AS median_quantity, median(l_extendedprice) AS median_price FROM lineitem GROUP BY ALL")
def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    quantity = V.exact_median(rows, keys, F.col("l_quantity"), "median_quantity")
    return quantity.join(V.exact_median(rows, keys, F.col("l_extendedprice"), "median_price"), keys)


@query(
    """WITH s AS (SELECT p_brand, round(p_retailprice / 50) / 2 AS v, sum(p_size) AS w FROM part GROUP BY ALL)
SELECT p_brand, arg_max(v, (w, -v)) AS mode_value, CAST(max(w) AS BIGINT) AS weight FROM s GROUP BY p_brand"""
)
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-unit price class of the largest total size, by brand."""
    value = F.round(F.col("p_retailprice") / 50) / 2
    return V.weighted_mode(table(spark, sf_dir, "part"), ["p_brand"], value, F.col("p_size").cast("bigint"), "mode_value")


@query(
    """WITH s AS (SELECT user_id, event_type, count(*) AS score FROM events GROUP BY ALL), t AS (SELECT user_id, max(score) AS top FROM s GROUP BY 1)
SELECT s.user_id, min(event_type) AS event_type, max(score) AS score FROM s JOIN t ON s.user_id = t.user_id AND score = top GROUP BY s.user_id"""
)
def argmax_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's most frequent event type, the first by name at a tie."""
    return V.arg_max(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.count("*"))


@query(
    """WITH p AS (SELECT conv_id, turn, length(trim(coalesce(text, ''))) > 50 AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT * FROM p WHERE turn <= 2 OR (n > 5 AND turn >= n - 2) OR (n > 10 AND turn IN (n // 3, 2 * n // 3)))
SELECT conv_id, CASE WHEN bool_and(t) THEN 'vector' WHEN bool_or(t) THEN 'mixed' ELSE 'scanned' END AS kind, count(*) AS sampled FROM s GROUP BY conv_id"""
)
def type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a document by the pages that the vote looks at: three first, two last, two inside."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.trim(F.coalesce("text", F.lit("")))) > 50).alias("t"), n.alias("n"))
    seen = pages.where("turn <= 2 OR (n > 5 AND turn >= n - 2) OR (n > 10 AND (turn = n div 3 OR turn = 2 * n div 3))")
    kind = F.when(F.bool_and("t"), "vector").when(F.bool_or("t"), "mixed").otherwise("scanned")
    return seen.groupBy("conv_id").agg(kind.alias("kind"), F.count("*").alias("sampled"))


@query("SELECT p_size, p_type, min(p_partkey) AS first_seen, list(p_partkey ORDER BY p_partkey) AS members FROM part GROUP BY p_size, p_type")
def size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.size_groups(table(spark, sf_dir, "part"), ["p_size", "p_type"], "p_partkey", "p_partkey")


@query(
    r"""SELECT p_partkey, upper(CASE WHEN regexp_replace(split_part(s, '-', 1), '[0-9]+$', '') = '' THEN s ELSE regexp_replace(split_part(s, '-', 1), '[0-9]+$', '') END) AS family
FROM (SELECT p_partkey, replace(p_brand, '#', '') || '-' || p_type AS s FROM part)"""
)
def family_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    font = F.concat(F.lit("ABCDEF+"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("-"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.family_key(font).alias("family"))


@query(
    r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'part') AS slug,
'page-' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS page_file, 'p' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '-b' || lpad(CAST(p_partkey % 100 AS VARCHAR), 4, '0') AS block_id FROM part"""
)
def slug_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type"), "part").alias("slug"), L.page_file(F.col("p_size")).alias("page_file"),
        L.block_id(F.col("p_size"), F.pmod("p_partkey", F.lit(100))).alias("block_id"),
    )


_ROMAN = "repeat('m', v // 1000) || " + " || ".join(
    f"list_extract({['', *row]!r}, v // {d} % 10 + 1)"
    for d, row in (
        (100, ["c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]),
        (10, ["x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]),
        (1, ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]),
    )
)


@query(f"SELECT p_partkey, {_ROMAN} AS label, 'roman' AS style, v AS value FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS v FROM part)")
def roman_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels in roman numerals, read back."""
    label = L.roman(F.pmod("p_partkey", F.lit(3999)) + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("p", L.parse_label(F.col("label")))
    return rows.select("p_partkey", "label", "p.style", "p.value")


@query("SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT CAST(props ->> 'k' AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy(F.pmod(k, F.lit(10)).alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM c) WHERE r <= 8")
def top_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest sources of each language: a top-k report."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))
    return counts.withColumn("r", rank).where("r <= 8").drop("r")


@query(
    """WITH c AS (SELECT l_suppkey, l_shipdate, count(*) OVER w AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT DISTINCT l_suppkey, n, CAST(r AS BIGINT) AS returned, r / n AS ratio, CASE WHEN r / n > 0.3 THEN 'high' ELSE 'low' END AS verdict FROM c"""
)
def ratio_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share against a threshold."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    ratio = F.col("returned") / F.col("n")
    return sums.select("l_suppkey", "n", "returned", ratio.alias("ratio"), F.when(ratio > 0.3, "high").otherwise("low").alias("verdict"))


@query("SELECT p_partkey // 2 AS pair, count(DISTINCT p_size % 5) AS n_sizes, count(DISTINCT p_size % 5) > 1 AS ambiguous, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with more than one distinct value, and the union of their extents."""
    sizes = F.count_distinct(F.col("p_size") % 5)
    return table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 2).alias("pair")).agg(sizes.alias("n_sizes"), (sizes > 1).alias("ambiguous"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
