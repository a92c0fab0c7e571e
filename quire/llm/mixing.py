"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

The mix is a run of slots of ``block`` words each. Slot i takes the i-th point of
the golden-ratio sequence, computed in integers modulo 2**60, and belongs to the
source whose share of the cumulative targets holds that point; so every stretch
of the schedule is close to the target weights. Slots are ranked within their
source. A source's documents, in a shuffled order that depends on their ids only,
lie end to end on a line that repeats; its r-th slot takes the r-th block of words
of that line, and joining slots to blocks says which words of which document the
slot gets. Where the points give a source fewer slots than its target has blocks,
the ranks that it lacks are dealt as well, spread evenly; its last block ends at its
target, which is at most twice its size, so no word is taken more than twice.

Scale: positions on the lines, ranks of slots, numbers and cumulative targets of
sources are prefix sums in two steps, inside buckets of bounded size and over the
bucket totals, so that no task sees a whole source or all sources. Sources meet
slots over cells of the unit interval, whose number follows the sources: an equi-join.
The block's length is a parameter, the same at every size of the input.

Defined cases: null text has size 0 and takes nothing; a null source is a source
of its own, last in the order; repeated rows are separate documents, and rows that are
equal in id and size may stand in either order; very long documents are cut into
blocks; other columns are ignored, whatever their names; a source without words has
target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all sizes: three halves
MOST = 2
#: Words of a slot.
BLOCK = 1024
CELLS = 4096
#: 2**60 / golden ratio, made odd, as three digits of 20 bits.
DIGIT = 1 << 20
STEP = (648055, 637311, 305089)
BUCKET_ROWS = 4096
SLOT_CHUNK = 1 << 16


def size_of(text: Column) -> Column:
    r"""Words ``[^\x20\x09-\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def running(rows: DataFrame, order: list, values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each new column, the sum of a column over all rows before, in two steps.

    Rows are dealt by ranges of the order into tasks of about BUCKET_ROWS rows, kept in a
    table; sums inside a range are added to those of the ranges before.
    """
    n = max(1, -(-rows.count() // BUCKET_ROWS))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    zero = F.lit(0)
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(f"_{new}") for new, c in values.items()])
    totals = totals.select("range", *[F.coalesce(F.sum(f"_{new}").over(before), zero).alias(f"_{new}") for new in values])
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(new) for new, c in values.items()]).join(F.broadcast(totals) if n == 1 else totals, "range")
    for new in values:
        out = out.withColumn(new, F.col(new) + F.col(f"_{new}"))
    return out.drop("range", *[f"_{new}" for new in values])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, source_no, weight, target) from (source, source_size); source_no counts from 0 by name.

    Shares by weight, cut at MOST times the size, the excess dealt again by weight:
    the fixed point is min(rate * weight, MOST * size) with one rate for all. With
    sources in order of MOST * size / weight, those that are cut come first, and the
    rate is the first of (total - what the cut ones take) / (the weight that is
    left) that does not exceed the next source's ratio, which is the largest that
    doesn't: from there on these quotients fall.
    """
    name = [F.col("source").isNull(), F.col("source")]
    each = running(sizes.withColumn("one", F.lit(1).cast("bigint")), name, {"source_no": "one"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    each = each.withColumn("weight", weight)
    each = running(each, [F.col("source_size") / F.col("weight"), *name], {"size_before": "source_size", "weight_before": "weight"})
    sums = each.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.lit(sums["size"] or 0).cast("bigint") * SHARE[0] / SHARE[1]
    rate = (share - MOST * F.col("size_before")) / (F.lit(sums["weight"] or 1).cast("bigint") - F.col("weight_before"))
    each = each.withColumn("rate", rate)
    best = each.where(F.col("rate") * F.col("weight") <= MOST * F.col("source_size")).agg(F.max("rate")).first()[0]
    target = F.least(F.lit(best or 0.0) * F.col("weight"), (MOST * F.col("source_size")).cast("double"))
    return each.select("source", "source_size", "source_no", "weight", target.alias("target"))


def point(i: Column) -> Column:
    """The point of slot ``i``: i * STEP mod 2**60 as a share of 1.

    The digits are multiplied one by one, so that no product of i < 2**42 overflows;
    the last 7 bits are cut, which a double can't hold.
    """
    value = F.lit(0).cast("bigint")
    for k, digit in enumerate(STEP):
        value = F.pmod(value * DIGIT + i * digit, F.lit(DIGIT ** (k + 1)))
    return F.shiftright(value, 7) / (1 << 53)


def schedule(spark, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, rank, slot) of every slot; ``shares``: source_no, target, goal."""
    totals = shares.agg(F.sum("target").alias("t"), F.count("*").alias("n")).first()
    n = int(-(-(totals.t or 0) // block))
    n_cells = max(CELLS, 4 * totals.n)
    slots = spark.range(n).withColumn("u", point(F.col("id")))
    slots = slots.withColumn("cell", F.floor(F.col("u") * n_cells).cast("int"))
    ends = running(shares.where("target > 0"), [F.col("source_no")], {"below": "target"})
    total, last = F.lit(totals.t or 1.0), ends.agg(F.max("source_no")).first()[0]
    # Equal expressions make a source's upper end the next one's lower end.
    above = F.when(F.col("source_no") == last, 1.0).otherwise((F.col("below") + F.col("target")) / total)
    ends = ends.withColumn("lo", F.col("below") / total).withColumn("hi", above)
    cells = F.sequence(F.floor(F.col("lo") * n_cells).cast("int"), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1)).cast("int"))
    ends = ends.where("lo < hi").select("source_no", "lo", "hi", F.explode(cells).alias("cell"))
    dealt = slots.join(ends, "cell").where("u >= lo AND u < hi").select("source_no", "id", F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"))
    counts = dealt.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source_no", "chunk", base.alias("base"))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("id")) - 1
    ranked = dealt.withColumn("inside", inside).join(counts, ["source_no", "chunk"])
    ranked = ranked.select("source_no", (F.col("base") + F.col("inside")).cast("bigint").alias("rank"), F.col("id").alias("slot"))
    return ranked.unionByName(_rest(dealt, shares, n, block))


def _rest(dealt: DataFrame, shares: DataFrame, n: int, block: int) -> DataFrame:
    """(source_no, rank, slot) of the ranks up to the goal that the ``n`` slots leave out."""
    had = shares.join(dealt.groupBy("source_no").agg(F.count("*").alias("had")), "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    short = had.withColumn("more", F.ceil(F.col("goal") / block) - F.col("had")).where("more > 0")
    each = short.select("source_no", "had", "more", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("more") - 1)).alias("i"))
    slot = F.floor((F.col("i") + 0.5) * n / F.col("more"))
    return each.select("source_no", (F.col("had") + F.col("i")).cast("bigint").alias("rank"), slot.cast("bigint").alias("slot"))


def key_of(source: Column) -> Column:
    """A source as a key that plain equality can join, null included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def lines(docs: DataFrame, plan: DataFrame, n_rows: int) -> DataFrame:
    """Adds the plan's columns of the source and ``start``: where the document lies on its source's line."""
    n_buckets = max(1, -(-n_rows // BUCKET_ROWS))
    digest = F.md5(F.concat(F.lit("mix-1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    each = docs.withColumn("digest", digest).withColumn("bucket", F.floor(first * n_buckets / F.lit(1 << 32)))
    totals = each.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("key", "bucket", base.cast("bigint").alias("base")).join(plan.drop("source"), "key")
    # Equal ids are ordered by size; rows that are equal in both may stand in either order.
    order = Window.partitionBy("key", "bucket").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = each.join(totals, ["key", "bucket"])
    return joined.withColumn("start", (F.col("base") + F.col("inside")).cast("bigint")).drop("bucket", "base", "inside", "digest")


def _pieces(block: int) -> Column:
    """What of the document's stretches of the repeated line lies before the goal, cut into blocks."""
    size, goal, zero, block = F.col("size"), F.col("goal"), F.lit(0).cast("bigint"), F.lit(block).cast("bigint")

    def of_lap(lap: Column) -> Column:
        lo = F.col("start") + lap * F.col("source_size")
        hi = F.least(lo + size, goal)
        ranks = F.sequence(F.floor(lo / block), F.greatest(F.floor((hi - 1) / block), F.floor(lo / block)))
        cut = F.transform(
            ranks,
            lambda r: F.struct(
                r.alias("rank"), (F.greatest(lo, r * block) - lo).alias("lo"), (F.least(hi, (r + 1) * block) - lo).alias("hi")
            ),
        )
        return F.filter(cut, lambda p: p["lo"] < p["hi"])

    laps = F.sequence(zero, F.lit(MOST - 1).cast("bigint"))
    return F.when(size > 0, F.flatten(F.transform(laps, of_lap)))


def pieces(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK
) -> DataFrame:
    """A row for each stretch of words that the mix takes: row, doc_id, source, size,
    source_size, target, slot, lo and hi (words of the document). A document of
    which nothing is taken has one row, without slot."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    sized = sized.withColumn("row", F.monotonically_increasing_id()).withColumn("key", key_of(F.col("source")))
    sums = written(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    n_rows = sums.agg(F.sum("n")).first()[0] or 0
    plan = written(targets(sums.select("source", "source_size"), weights), "mix-plan")
    plan = plan.withColumn("key", key_of(F.col("source"))).withColumn("goal", F.floor("target").cast("bigint"))
    placed = lines(sized, plan, n_rows).withColumn("p", F.explode_outer(_pieces(block)))
    placed = placed.select("row", "doc_id", "source", "size", "source_size", "target", "source_no", "p.rank", "p.lo", "p.hi")
    slots = schedule(docs.sparkSession, plan.select("source_no", "target", "goal"), block)
    return placed.join(slots, ["source_no", "rank"], "left").drop("source_no", "rank")


def mix(docs: DataFrame, **columns) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken."""
    length = F.when(F.col("slot").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0)
    by = ["row", "doc_id", "source", "size", "source_size", "target"]
    return pieces(docs, **columns).groupBy(*by).agg(F.sum(length).cast("bigint").alias("taken")).drop("row")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    from quire.session import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (SELECT row_number() OVER () AS k, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS source_no FROM z),
w AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM n),
r AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 3 / 2 - 2 * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rate
  FROM w WINDOW b AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(coalesce(max(CASE WHEN rate * weight <= 2 * source_size THEN rate END) OVER () * weight, 0), CAST(2 * source_size AS DOUBLE)) AS target FROM r),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM t),
l AS (SELECT s.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM s)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(st + size, goal) - st) + greatest(0, least(st + source_size + size, goal) - st - source_size) AS BIGINT) AS taken
FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source
"""
