"""The lexer and passes over document columns, Arrow-batched; a cheap test keeps other documents out of Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.latex import pages, passes
from quire.latex.lexer import Scan

NOTES = "array<struct<line: int, kind: string, detail: string>>"


def rows_of(docs: DataFrame, make: Callable[[str], list[tuple]], schema: str, contains: str | None = None, doc: str = "doc", source: str = "source") -> DataFrame:
    """doc and the fields of ``schema`` for every row that ``make`` finds in a source."""
    names = ["doc", *(x.strip().split(" ")[0] for x in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, *row) for d, s in zip(b["doc"], b["source"], strict=True) for row in make(s)], columns=names)

    slim = docs.where(F.col(source).isNotNull()).select(F.col(doc).alias("doc"), F.col(source).alias("source"))
    if contains:
        slim = slim.where(F.contains("source", F.lit(contains)))
    return slim.mapInPandas(run, f"doc {dict(slim.dtypes)['doc']}, {schema}")


def tokens(docs: DataFrame, **columns) -> DataFrame:
    """(doc, start, end, line, kind, name, active): the tokens of each source but plain text."""
    return rows_of(docs, lambda s: Scan(s).rows(), "start int, end int, line int, kind string, name string, active boolean", **columns)


def environment_issues(docs: DataFrame, **columns) -> DataFrame:
    return rows_of(docs, passes.environment_issues, "kind string, environment string, line int", **columns)


def log_errors(logs: DataFrame, **columns) -> DataFrame:
    return rows_of(logs, passes.log_errors, "category string, line double, message string", **columns).withColumn("line", F.col("line").cast("int"))


def rewritten(docs: DataFrame, step: Callable[[str], tuple[str, list]], contains: str | None = None, doc: str = "doc", source: str = "source") -> DataFrame:
    """(doc, source, notes) after a pass; documents without ``contains`` keep their source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [step(s) for s in b["source"]]
            notes = [[{"line": n[0], "kind": n[1], "detail": n[2]} for n in x[1]] for x in out]
            yield pd.DataFrame({"doc": b["doc"], "source": [x[0] for x in out], "notes": notes})

    slim = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    hit = F.contains("source", F.lit(contains)) if contains else F.lit(True)
    done = slim.where(hit).mapInPandas(run, f"doc {dict(slim.dtypes)['doc']}, source string, notes {NOTES}")
    return done.unionByName(slim.where(~hit).withColumn("notes", F.array().cast(NOTES))) if contains else done


def page_duplicates(docs: DataFrame, **columns) -> DataFrame:
    """Lines repeated across page boundaries removed; a note for each deleted or vetoed line."""

    def step(s: str) -> tuple[str, list]:
        planned, deleted = passes.duplicate_plan(s)
        return passes.page_duplicates(s), [(i + 1, "deleted" if i in deleted else "vetoed", "") for i in sorted(planned)]

    return rewritten(docs, step, "===", **columns)


def page_counters(docs: DataFrame, **columns) -> DataFrame:
    return rewritten(docs, pages.page_counters, "===", **columns)


def split_lists(docs: DataFrame, **columns) -> DataFrame:
    return rewritten(docs, pages.split_lists, "\\item", **columns)


def text_normalized(docs: DataFrame, table: list[tuple[str, str]] | None = None, markers: bool = True, **columns) -> DataFrame:
    """The passes that need nothing but the text; whole projects go through quire.latex.project."""

    def step(s: str) -> tuple[str, list]:
        s, counts = passes.normalize(s, table, markers)
        return s, [(0, k, str(n)) for k, n in counts.items() if n]

    return rewritten(docs, step, **columns)


def passed(docs: DataFrame, step: Callable[[str], str | tuple[str, int]], contains: str | None = None, **columns) -> DataFrame:
    """(doc, source) after one pass."""
    text = lambda got: got[0] if isinstance(got, tuple) else got
    return rewritten(docs, lambda s: (text(step(s)), []), contains, **columns).select("doc", "source")
