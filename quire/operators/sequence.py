"""Operators over ordered rows, as windows: sessions, intervals, islands, look-ahead, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

#: Rows of a range that one task sorts.
RANGE_ROWS = 1 << 19


def _window(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order)


def clusters(df: DataFrame, keys: list[str], order: list, breaks: Column, name: str = "cluster_id") -> DataFrame:
    """Number the runs of rows; ``breaks`` (over the same window) is true where a row starts a new one."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.coalesce(F.col("__b"), F.lit(True)), 1).otherwise(0)
    return df.withColumn("__b", breaks).withColumn(name, F.sum(start).over(w).cast("bigint")).drop("__b")


def sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, tie: str, name: str = "cluster_id") -> DataFrame:
    """Runs of rows at most ``gap_seconds`` apart."""
    w = _window(keys, [ts, tie])
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    return clusters(df, keys, [ts, tie], seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000, name)


def merged_intervals(df: DataFrame, keys: list[str], lo: str, hi: str, gap: float = 0) -> DataFrame:
    """Unions of intervals that overlap or lie at most ``gap`` apart: keys, lo, hi, n."""
    furthest = F.max(hi).over(_window(keys, [lo, hi]).rowsBetween(Window.unboundedPreceding, -1))
    numbered = clusters(df, keys, [lo, hi], F.col(lo) > furthest + F.lit(gap), "__c")
    return numbered.groupBy(*keys, "__c").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("__c")


def range_ends(df: DataFrame, keys: list[str], start: str, order: list, last: Column, inclusive: bool = True, name: str = "range_end") -> DataFrame:
    """The end of each range: just before the next start (inclusive) or at it (half-open), ``last`` for the last."""
    following = F.lead(start).over(_window(keys, order))
    return df.withColumn(name, F.coalesce(following - 1 if inclusive else following, last))


def islands(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Runs of consecutive distinct numbers: keys, first, last, n."""
    distinct = df.select(*keys, n).where(F.col(n).isNotNull()).distinct()
    group = F.col(n) - F.row_number().over(_window(keys, [n]))
    return distinct.withColumn("__g", group).groupBy(*keys, "__g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("n")).drop("__g")


def run_text(runs: DataFrame, keys: list[str], name: str = "ranges") -> DataFrame:
    """Runs written as "1-4, 7, 9-10"."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat("first", F.lit("-"), "last"))
    pairs = F.array_sort(F.collect_list(F.struct("first", one.alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), ", ").alias(name))


def as_of(df: DataFrame, keys: list[str], order: list, value: Column, name: str, strict: bool = False) -> DataFrame:
    """The last value that is not null at a row or before it (``strict``: before it only)."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def look_ahead(df: DataFrame, keys: list[str], order: list, value: Column, rows: int, name: str) -> DataFrame:
    """The first value that is not null among the next ``rows`` rows."""
    w = _window(keys, order).rowsBetween(1, rows)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(w))


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(_window(keys, order))).where("__r = 1").drop("__r")


def without_repeats(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose next row has another value: of adjacent equals the last stays."""
    following = F.lead(value).over(_window(keys, order))
    return df.withColumn("__n", following).where(~F.col(value).eqNullSafe(F.col("__n")) | F.col("__n").isNull()).drop("__n")


def ranked(df: DataFrame, keys: list[str], order: list, name: str, size: str) -> DataFrame:
    """Adds a row's number within its key, from 0, and the key's rows, in two steps, for few large keys.

    Ranges of keys and order follow the input, so that no task sorts a whole key; the rows that a
    key has in the ranges before are added to the places within a range. Null is a key like others.
    """
    n = max(1, -(-df.count() // RANGE_ROWS))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(dealt.withColumn("__id", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()), "ranks")
    parts = placed.groupBy("__range", *keys).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = _window(keys, ["__range"]).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("__first") - F.coalesce(F.sum("__n").over(before), F.lit(0))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    # A table, so that its size is known and decides how it is joined.
    parts = written(parts.select(F.col("__range").alias("__r"), *named, base.alias("__base"), total.alias(size)), "rank-parts")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(parts, same).select(*df.columns, (F.col("__id") - F.col("__base")).alias(name), size)


def stride(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Every step-th row from the first; step = max(1, rows / k)."""
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    return ranked(df, keys, order, "__i", "__n").where(F.pmod("__i", step) == 0).drop("__i", "__n")


def batches(df: DataFrame, keys: list[str], order: list, size: int, name: str = "batch") -> DataFrame:
    return df.withColumn(name, F.floor((F.row_number().over(_window(keys, order)) - 1) / size).cast("bigint"))


def boundary_overlaps(lines: DataFrame, doc: str, page: str, pos: str, line: str, window: int = 5) -> DataFrame:
    """For neighbouring pages: the largest k <= window such that the last k comparable lines
    of one equal the first k of the next. Blank and %% lines are not comparable."""
    trimmed = F.trim(F.col(line))
    rows = lines.where((trimmed != "") & ~trimmed.startswith("%%")).withColumn("__t", trimmed)
    head = F.row_number().over(Window.partitionBy(doc, page).orderBy(pos))
    tail = F.row_number().over(Window.partitionBy(doc, page).orderBy(F.col(pos).desc()))
    rows = rows.withColumn("__h", head).withColumn("__e", tail).where((F.col("__h") <= window) | (F.col("__e") <= window))
    pick = lambda rank: F.transform(F.array_sort(F.collect_list(F.when(F.col(rank) <= window, F.struct(pos, "__t")))), lambda x: x["__t"])
    ends = rows.groupBy(doc, page).agg(pick("__h").alias("head"), pick("__e").alias("tail"))
    after = F.lead(F.struct(F.col(page).alias("p"), F.col("head").alias("h"))).over(Window.partitionBy(doc).orderBy(page))
    both = ends.withColumn("__n", after).where(F.col("__n.p") == F.col(page) + 1)
    k = F.lit(0)
    for i in range(1, window + 1):
        enough = (F.size("tail") >= i) & (F.size("__n.h") >= i)
        same = F.slice("tail", -i, i) == F.slice("__n.h", 1, i)
        k = F.when(enough & same, i).otherwise(k)
    return both.select(doc, page, k.alias("overlap")).where("overlap > 0")
