"""The corpus pipeline: stages that each take the documents the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Each result is written as a table and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.

Defined cases of every stage: null and repeated ids are rows like others; a null or empty
text isn't toxic, fails the quality rules, is near nothing, holds no passage and has size
0; very long texts are worked off whole; columns beyond those of ``documents`` are left
out; an empty table gives an empty table. Without labels no text is toxic, and without a
benchmark none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard_join, mixing, quality_rules, toxicity, winnowing
from quire.session import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't find toxic; it is fitted on labelled rows of ``documents``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(COLUMNS))
    return scored.where(F.col("p_toxic") < toxicity.REJECT).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    entries = quality_rules.ledger(docs, keep=tuple(COLUMNS))
    return quality_rules.apply_policy(entries).where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows carry a key of their own, so ids may be null or stand on several texts: of rows
    that repeat one stays, a null id comes after all others, and documents without words
    are linked with nothing and stay.
    """
    keyed = written(docs.withColumn("row_key", F.monotonically_increasing_id()), "pipeline-keyed")
    found = jaccard_join.similar(keyed, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    named = found.join(keyed.select("row_key", "doc_id"), "row_key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("m")).select("m.row_key")
    return keyed.join(first, "row_key", "left_semi").select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    One item's passage is enough to leak its answer: a document goes if windows of any item,
    with or without an id, cover at least a whole window's words. Items shorter than a window
    can stand in clean text by chance, so alone they reject only documents that they cover
    that far.
    """
    out = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return out.where(F.col("n_hit") < winnowing.WINDOW).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", keep_clean),
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", keep_uncontaminated),
    ("source_mixing", mix_sources),
]

#: SQL can't express the first stage; tests/llm holds the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
