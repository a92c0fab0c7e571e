"""Queries that run the lexer and the passes, on conversations written as LaTeX pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.latex import figures, project, udfs
from quire.operators import votes
from quire.plans.registry import query
from quire.plans.text_queries import accumulated
from quire.session import table


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, source): pages with markers, user turns as chapters, a price and a figure on each page."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    first = F.substring_index("text", "\n", 1)
    title = F.when(F.col("role") == "user", F.concat(F.lit("\\chapter{Turn "), F.col("turn"), F.lit("}\n"))).otherwise("")
    figure = F.concat(F.lit("\n\\includegraphics{figures/fig"), F.col("turn") % 3, F.lit("}\ncosts $"), F.length("text"), F.lit("\n"), first)
    rows = turns.withColumn("text", F.concat(title, F.col("text"), figure))
    page = F.concat(F.lit("%% === Page "), F.col("turn") + 1, F.lit(" ===\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", page.alias("t"))))
    body = F.array_join(F.transform(parts, lambda p: p["t"]), "\n")
    return rows.groupBy(F.col("conv_id").alias("doc")).agg(F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n"), body).alias("source"))


@query()
def lexer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.tokens(sources(spark, sf_dir))


@query()
def env_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.environment_issues(sources(spark, sf_dir))


@query()
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole projects: all passes in order, figure widths among them."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("page"), "turn")
    figs = turns.select("doc", "page", F.concat(F.lit("fig"), F.col("turn") % 3).alias("id"), F.array(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.5)).alias("bbox"))
    sizes = turns.select("doc", "page", F.lit(612.0).alias("width"))
    files = turns.select("doc", F.concat(F.lit("figures/fig"), F.col("turn") % 3, F.lit(".png")).alias("path")).distinct()
    known = [F.lit(v).alias(k) for k, v in (("paper", "a4paper"), ("family", "times"), ("encoding", "T1"), ("body_size", 11.0))]
    return project.normalized(sources(spark, sf_dir).select("*", *known), figs, sizes, files)


@query()
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.text_normalized(sources(spark, sf_dir), [("cost", "price")], markers=False)


@query()
def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.page_counters(sources(spark, sf_dir))


@query()
def page_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.page_duplicates(accumulated(spark, sf_dir).withColumnRenamed("conv_id", "doc"))


@query()
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's lines as items of a list that ends with the page."""
    turns = table(spark, sf_dir, "conversations")
    items = F.concat(F.lit("\\begin{itemize}\n\\item "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\\item ")), F.lit("\n\\end{itemize}"))
    page = F.concat(F.lit("%% === Page "), F.col("turn") + 1, F.lit(" ===\n\\item first\n"), items)
    parts = F.array_sort(F.collect_list(F.struct("turn", page.alias("t"))))
    docs = turns.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("source"))
    return udfs.split_lists(docs)


@query()
def figure_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the included figures from boxes, page sizes and files."""
    docs = sources(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("page"), "turn")
    box = F.array(F.lit(0.1), F.lit(0.1), 0.1 + F.col("turn") * 0.11, F.lit(0.5))
    figs = turns.select("doc", "page", F.concat(F.lit("fig"), F.col("turn") % 3).alias("id"), box.alias("bbox"))
    pages = turns.where("page != 4").select("doc", "page", F.lit(612.0).alias("width"))
    files = turns.where("page != 3").select("doc", F.concat(F.lit("figures/fig"), F.col("turn") % 3, F.lit(".png")).alias("path")).distinct()
    return figures.figure_widths(figures.graphics_calls(docs), figs, pages, files)


@query()
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of compile logs, one log for each error event."""
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    kinds = F.array(*map(F.lit, ("Undefined control sequence.", "Missing $ inserted.", "Missing } inserted.", "LaTeX Error: Environment x undefined.", "Emergency stop.")))
    log = F.concat(F.lit("This is a log\n! "), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")), F.lit("\n<recently read>\nl."), F.col("event_id"), F.lit(" \\x\nLaTeX Warning: y"))
    return udfs.log_errors(events.select(F.col("event_id").alias("doc"), log.alias("source")))


FONTS = ("ABCDEF+CMR10", "CMBX12", "SFRM1000", "Times-Roman", "Calibri", "CMMI10", "LMRoman10-Regular", "Helvetica")


@query()
def source_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, encoding and family of each supplier's parts, with brands as fonts."""
    font = F.element_at(F.array(*map(F.lit, FONTS)), (F.col("l_partkey") % 8 + 1).cast("int"))
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), font.alias("font")).agg(F.count("*").alias("n"))
    family = counts.withColumn("family", votes.font_family(F.col("font"))).where("family IS NOT NULL")
    best = votes.arg_max(family, ["doc"], "family", F.sum("n"), "family_score")
    return votes.source_from_fonts(counts, ["doc"]).join(votes.font_encoding(counts, ["doc"]), "doc", "left").join(best, "doc", "left")
