"""Join shapes beyond plain equality, built from equality joins wherever possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.sequence import ranked

#: Rows up to which a side may be broadcast, after counting it.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def full_outer_report(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides by key: ``both``, ``missing_in_b`` (zeros for b) or ``only_in_b``."""
    x, y = a.select(key, F.col(value).alias("a_value"), F.lit(True).alias("in_a")), b.select(key, F.col(value).alias("b_value"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing_in_b").when(F.col("in_a").isNull(), "only_in_b").otherwise("both")
    return x.join(y, key, "full").select(key, "a_value", F.coalesce("b_value", F.lit(0)).alias("b_value"), status.alias("status"))


def range_expand(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """A row for each whole number of [lo, hi], so that a range join becomes an equality join."""
    return df.where(F.col(lo) <= F.col(hi)).withColumn(name, F.explode(F.sequence(lo, hi)))


def clipped(ranges: DataFrame, lo: str, hi: str, first: Column, last: Column) -> DataFrame:
    """Ranges cut to [first, last]; those outside are dropped."""
    return ranges.withColumn(lo, F.greatest(F.col(lo), first)).withColumn(hi, F.least(F.col(hi), last)).where(F.col(lo) <= F.col(hi))


def snapped(value: Column, to: list[float]) -> Column:
    """The nearest of a few values, the first at a tie."""
    each = F.array(*[F.struct(F.abs(value - x).alias("d"), F.lit(i).alias("i"), F.lit(x).alias("v")) for i, x in enumerate(to)])
    return F.array_min(each)["v"]


def first_candidate(df: DataFrame, row_key: str, candidates: list[Column], known: DataFrame, known_key: str) -> DataFrame:
    """Join each row by the first of its candidate keys that ``known`` has: row_key, matched, priority."""
    options = F.array(*[F.struct(F.lit(i).alias("p"), c.alias("c")) for i, c in enumerate(candidates)])
    rows = df.select(row_key, F.explode(options).alias("o")).select(row_key, "o.p", F.col("o.c").alias(known_key))
    found = rows.join(known.select(known_key).distinct(), known_key)
    best = found.groupBy(row_key).agg(F.min(F.struct("p", known_key)).alias("m"))
    return best.select(row_key, F.col(f"m.{known_key}").alias("matched"), F.col("m.p").alias("priority"))


def nested_prefixes(a: DataFrame, b: DataFrame, key: str, prefix: str, least: int) -> DataFrame:
    """For each row of ``a`` the smallest key of ``b`` whose string begins its string, or is begun by it: key, matched.

    Both directions are equalities of a prefix with a whole string; strings have ``least`` letters or more."""
    whole = b.groupBy(prefix).agg(F.min(key).alias("matched"))
    lengths = F.sequence(F.lit(least), F.length(prefix))
    cut = lambda df: df.where(F.length(prefix) >= least).withColumn("__p", F.explode(F.transform(lengths, lambda n: F.substring(F.col(prefix), F.lit(1), n))))
    begins = cut(a).select(key, F.col("__p").alias(prefix)).join(whole, prefix).select(key, "matched")
    begun = cut(whole).groupBy("__p").agg(F.min("matched").alias("matched")).withColumnRenamed("__p", prefix)
    begun = a.where(F.length(prefix) >= least).join(begun, prefix).select(key, "matched")
    return begins.unionByName(begun).groupBy(key).agg(F.min("matched").alias("matched"))


def interval_overlaps(a: DataFrame, b: DataFrame, key: str, width: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs of half-open intervals of the same key that overlap, met in cells of ``width``.

    A pair is counted in the cell where its overlap starts, so it appears once.
    """
    cells = lambda x: F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))
    x = a.withColumn("__c", F.explode(cells(a))).withColumnsRenamed({lo: "a_lo", hi: "a_hi"})
    y = b.withColumn("__c", F.explode(cells(b))).withColumnsRenamed({lo: "b_lo", hi: "b_hi"})
    start = F.greatest("a_lo", "b_lo")
    met = x.join(y, [key, "__c"]).where((F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi")))
    met = met.where(F.floor(start / width) == F.col("__c")).drop("__c")
    return met.withColumn("overlap", F.least("a_hi", "b_hi") - start)


def latest(log: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The newest state of each key in an append-only log; equal times by the next columns of ``order``."""
    newest = F.max_by(F.struct(*value), F.struct(*order))
    return log.groupBy(key).agg(newest.alias("__v")).select(key, "__v.*")


def zipped(a: DataFrame, b: DataFrame, order_a: list, order_b: list, keys: list[str]) -> DataFrame:
    """Rows of equal position within a key, up to the shorter side."""
    number = lambda df, order: ranked(df, keys, order, "__i", "__n").withColumn("pos", F.col("__i") + 1).drop("__i", "__n")
    return number(a, order_a).join(number(b, order_b), [*keys, "pos"])


def rule_hits(texts: DataFrame, text: str, rules: list[tuple[str, str]], name: str = "rule") -> DataFrame:
    """A row for each rule whose pattern occurs in a text; the rules are a literal array, not a join."""
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in rules])
    hits = F.filter(every, lambda r: F.contains(F.col(text), r["pattern"]))
    return texts.withColumn("__h", F.explode(hits)).withColumn(name, F.col("__h.name")).drop("__h")
