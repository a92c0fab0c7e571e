"""Comparison of two documents by chapter, segment, font and page size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: A chapter below this similarity is looked at in segments of so many pages.
WEAK, SEGMENT_PAGES = 0.60, 5
#: Decimals that are tried for page sizes, and what stands for the shortest form that reads back.
DECIMALS, EXACT = (2, 4, 6, 8, 10, 12, 14, 16), 2147483647


def range_words(pages: DataFrame, ranges: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``ranges`` (keys, start_page, end_page; the end is not part of it) with the distinct words of their pages.

    Pages and ranges meet page by page; words of a range are made distinct before they are gathered.
    """
    doc = keys[0]
    each = ranges.where("start_page < end_page").withColumn("page", F.explode(F.sequence("start_page", F.col("end_page") - 1)))
    words = pages.select(doc, "page", F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("word"))
    found = each.select(*keys, "page").join(words, [doc, "page"]).groupBy(*keys).agg(F.collect_set("word").alias(name))
    return ranges.join(found, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def chapter_report(a_pages: DataFrame, a_chapters: DataFrame, b_pages: DataFrame, b_chapters: DataFrame, doc: str = "doc") -> DataFrame:
    """A row for each chapter of either side: pages, word coverage to 4 decimals, and a status where a side lacks it.

    ``pages``: doc, page, text; ``chapters``: doc, chapter, title, start_page, end_page.
    The title is the original's; coverage is 0 where one side has no such chapter.
    """
    keys = [doc, "chapter"]
    n = (F.col("end_page") - F.col("start_page")).cast("bigint")
    a = range_words(a_pages, a_chapters, keys, "wa").select(*keys, F.col("title").alias("title_a"), n.alias("orig_pages"), "wa")
    b = range_words(b_pages, b_chapters, keys, "wb").select(*keys, F.col("title").alias("title_b"), n.alias("repr_pages"), "wb")
    both = a.join(b, keys, "full")
    zero = F.lit(0).cast("bigint")
    status = F.when(F.col("wb").isNull(), "missing_in_reproduced").when(F.col("wa").isNull(), "missing_in_original")
    coverage = F.when(status.isNull(), F.round(T.set_coverage(F.col("wa"), F.col("wb")), 4)).otherwise(0.0)
    return both.select(
        *keys, F.coalesce("title_a", "title_b").alias("title"), F.coalesce("orig_pages", zero).alias("orig_pages"), F.coalesce("repr_pages", zero).alias("repr_pages"),
        coverage.alias("word_coverage"), status.alias("status"),
    )


def chapter_summary(report: DataFrame, doc: str = "doc", measure: str = "word_coverage") -> DataFrame:
    """For each document: the mean of the chapters that both sides have (0 without any), and the numbers of the missing ones."""
    valid = F.col("status").isNull()
    missing = F.array_sort(F.collect_list(F.when(F.col("status") == "missing_in_reproduced", F.col("chapter"))))
    return report.groupBy(doc).agg(
        F.coalesce(F.avg(F.when(valid, F.col(measure))), F.lit(0.0)).alias("average"), F.count_if(valid).alias("valid_chapters"), missing.alias("missing")
    )


def segments(a: DataFrame, b: DataFrame, keys: list[str], pages: int = SEGMENT_PAGES) -> DataFrame:
    """Chapters of both sides cut into as many equal segments: keys, segment, a_start, a_end, b_start, b_end, label.

    There is one segment for each ``pages`` pages of the original, one at least; the
    labels count the original's pages from 1.
    """
    side = lambda df, s: df.select(*keys, F.col("start_page").alias(f"{s}0"), (F.col("end_page") - F.col("start_page")).alias(f"n{s}"))
    both = side(a, "a").join(side(b, "b"), keys).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("na") / pages)).cast("bigint"))
    both = both.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    at = lambda s, i: (F.col(f"{s}0") + F.floor(i * F.col(f"n{s}") / F.col("k"))).cast("bigint")
    i = F.col("segment")
    out = both.select(*keys, "segment", *[at(s, j).alias(f"{s}_{end}") for s in "ab" for j, end in ((i, "start"), (i + 1, "end"))], "a0")
    label = F.concat(F.lit("pp "), F.col("a_start") - F.col("a0") + 1, F.lit("-"), F.col("a_end") - F.col("a0"))
    return out.withColumn("label", label).drop("a0")


def worst(df: DataFrame, keys: list[str], measure: str, order: str, keep: list[str]) -> DataFrame:
    """For each key the row of the smallest measure, the first of equals."""
    least = F.min_by(F.struct(measure, *keep), F.struct(measure, order))
    return df.groupBy(*keys).agg(least.alias("w")).select(*keys, "w.*")


def font_pages(fonts: DataFrame, doc: str = "doc", page: str = "page", font: str = "font") -> DataFrame:
    """(doc, font, n): on how many pages a font stands. A page counts each raw name once; the subset's prefix
    goes afterwards, so two subsets of one font on a page count twice."""
    raw = fonts.select(doc, page, font).distinct()
    return raw.groupBy(doc, T.without_subset_prefix(F.col(font)).alias("font")).agg(F.count("*").alias("n"))


def font_families(counts: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, family, n): font_pages summed by family key."""
    return counts.groupBy(doc, T.family_key(F.col("font")).alias("family")).agg(F.sum("n").alias("n"))


def size_mismatches(a: DataFrame, b: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, verdict, pages): pages that both sides have and whose sizes differ at all; sides: doc, page, width, height."""
    side = lambda df, s: df.select(doc, "page", F.col("width").alias(f"w{s}"), F.col("height").alias(f"h{s}"))
    differs = (F.col("wa") != F.col("wb")) | (F.col("ha") != F.col("hb"))
    pages = F.array_sort(F.collect_list(F.when(differs, F.col("page"))))
    out = side(a, "a").join(side(b, "b"), [doc, "page"]).groupBy(doc).agg(pages.alias("pages"))
    verdict = F.when(F.size("pages") == 0, "OK").otherwise(F.concat(F.lit("MISMATCH (pages "), page_ranges(F.col("pages")), F.lit(")")))
    return out.select(doc, verdict.alias("verdict"), "pages")


def page_ranges(pages: Column) -> Column:
    """Ascending page numbers as ``1-3, 7``."""
    steps = F.transform(pages, lambda p, i: F.struct(p.alias("p"), (p - i).alias("run")))
    runs = F.array_distinct(F.transform(steps, lambda s: s["run"]))

    def one(run: Column) -> Column:
        inside = F.transform(F.filter(steps, lambda s: s["run"] == run), lambda s: s["p"])
        first, last = F.element_at(inside, 1).cast("string"), F.element_at(inside, -1).cast("string")
        return F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), last))

    return F.array_join(F.transform(runs, one), ", ")


def min_precision(sizes: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, decimals): the fewest decimals at which all distinct sizes of a document print differently, EXACT if none does."""
    distinct = sizes.select(doc, "width", "height").distinct()
    tried = distinct.select(doc, F.explode(F.array(*[
        F.struct(F.lit(d).alias("d"), F.format_string(f"%.{d}f x %.{d}f", "width", "height").alias("label")) for d in DECIMALS
    ])).alias("t")).select(doc, "t.*")
    n = distinct.groupBy(doc).agg(F.count("*").alias("n"))
    labels = tried.distinct().groupBy(doc, "d").agg(F.count("*").alias("labels"))
    fits = labels.join(n, doc).where("labels = n").groupBy(doc).agg(F.min("d").alias("decimals"))
    return n.join(fits, doc, "left").select(doc, F.coalesce("decimals", F.lit(EXACT)).alias("decimals"))


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with ``ord``, the row's number within its key from 0."""
    return df.withColumn("ord", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))
