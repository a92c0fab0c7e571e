"""Project files as tables: manifests, page files, AI responses, outlines, logs; and their sinks.

Everything is read and written by Spark, so a folder can be in any store it knows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "number INT, width DOUBLE, height DOUBLE, rotation INT, renderedImagePath STRING, renderedDPI DOUBLE, label STRING"
BOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
OCR = "pageNumber INT, ocrText STRING, pdfkitText STRING, ocrTextPath STRING, agreement DOUBLE, hasConflicts BOOLEAN"
MANIFEST = (
    "schemaVersion INT, createdAt STRING, updatedAt STRING, projectName STRING, sourcePDF STRING, projectRoot STRING, "
    f"pages ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in PAGE.split(','))}>>, blocks ARRAY<STRUCT<"
    "id: STRING, page: INT, type: STRING, status: STRING, bbox: STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>, imagePath: STRING, "
    "latexPath: STRING, textPreview: STRING, notes: STRING, attemptCount: INT, lastAttemptAt: STRING, completedAt: STRING, lastModel: STRING, "
    f"lastReasoningEffort: STRING, lastTimeoutSeconds: DOUBLE>>, ocrResults ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in OCR.split(','))}>>"
)
FIGURE = "STRUCT<id: STRING, bbox: ARRAY<DOUBLE>, caption: STRING>"
UNCERTAIN = "STRUCT<snippet: STRING, reason: STRING, description: STRING, alternatives: ARRAY<STRING>>"
RESPONSE = f"pages ARRAY<STRUCT<page: INT, latex: STRING, figures: ARRAY<{FIGURE}>, confidence: DOUBLE, notes: STRING, uncertainties: ARRAY<{UNCERTAIN}>>>, _corrupt STRING"
CHAPTERS = "strategy STRING, generatedAt STRING, sourcePDF STRING, chapters ARRAY<STRUCT<id: STRING, title: STRING, startPage: INT, endPage: INT>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each manifest; a manifest without OCR results has an empty list."""
    empty = F.array().cast(dict(spark.createDataFrame([], MANIFEST).dtypes)["ocrResults"])
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("ocrResults", F.coalesce("ocrResults", empty))


def write_manifest(df: DataFrame, path: str) -> None:
    """Fields without a value are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def page_labels(manifests: DataFrame) -> DataFrame:
    """(projectRoot, page, label): the first label of each page number."""
    rows = manifests.select("projectRoot", F.posexplode("pages").alias("i", "p")).where("p.label IS NOT NULL")
    return rows.groupBy("projectRoot", F.col("p.number").alias("page")).agg(F.min_by("p.label", "i").alias("label"))


def without_fence(c: Column) -> Column:
    """JSON inside a Markdown fence, or the text itself."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*\n(.*?)\n?```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(c), F.lit(" \t\r\n"))


def parse_responses(texts: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``readable`` and ``pages``. Garbage parses to a row of nulls, so it is told by the corrupt-record field."""
    parsed = F.from_json(without_fence(F.col(text)), RESPONSE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = texts.withColumn("__r", parsed)
    good = F.col("__r._corrupt").isNull() & F.col("__r.pages").isNotNull()
    return rows.withColumn("readable", F.coalesce(good, F.lit(False))).withColumn("pages", F.col("__r.pages")).drop("__r")


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """(file, readable, pages) of every JSON file of a folder, each read whole."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return parse_responses(files.select(F.col("_metadata.file_name").alias("file"), "value")).drop("value")


def response_figures(responses: DataFrame) -> DataFrame:
    """(page, id, bbox, caption): figures of readable responses; of a page's responses the first by file counts."""
    pages = responses.where("readable").select("file", F.posexplode("pages").alias("i", "p"))
    first = pages.groupBy(F.col("p.page").alias("page")).agg(F.min_by("p.figures", F.struct("file", "i")).alias("figures"))
    return first.select("page", F.explode("figures").alias("f")).select("page", "f.*")


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(page, source): files whose name is exactly page-%04d.tex."""
    files = spark.read.option("pathGlobFilter", "page-*.tex").text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("source"))
    number = F.expr("try_cast(regexp_extract(file, '^page-([0-9]+)\\\\.tex$', 1) AS INT)")
    return rows.withColumn("page", number).where(F.concat(F.format_string("page-%04d", "page"), F.lit(".tex")) == F.col("file")).select("page", "source")


def accumulate(pages: DataFrame, wanted: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, source): pages joined in order under their markers; fails where a wanted page has no source."""
    missing = F.raise_error(F.concat(F.lit("no source for page "), F.col("page").cast("string")))
    rows = wanted.join(pages, [doc, "page"], "left").withColumn("source", F.when(F.col("source").isNull(), missing.cast("string")).otherwise(F.col("source")))
    marked = F.when(F.startswith("source", F.lit("%% ===")), F.col("source")).otherwise(F.concat(F.lit("%% === Page "), F.col("page").cast("string"), F.lit(" ===\n"), F.col("source")))
    parts = F.array_sort(F.collect_list(F.struct("page", marked.alias("t"))))
    return rows.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("source"))


def placeholders(wanted: DataFrame, pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pages with a placeholder for those that have no source yet."""
    return pages.unionByName(wanted.join(pages, keys, "left_anti").withColumn("source", F.lit(text)))


def page_range(total: Column, first: Column, last: Column) -> Column:
    """Page numbers of [first, last] within [1, total]; fails where first is after last."""
    lo, hi = F.greatest(F.lit(1), F.coalesce(first, F.lit(1))), F.least(total, F.coalesce(last, total))
    bad = F.raise_error(F.lit("the first page is after the last")).cast("array<int>")
    return F.when(total == 0, F.array().cast("array<int>")).when(first > last, bad).when(lo > hi, F.array().cast("array<int>")).otherwise(F.sequence(lo, hi))


def ranges_from_text(c: Column, total: Column) -> Column:
    """Chapters from "1-24,25-60": array of id, title, start, end; fails on bad tokens and ranges."""

    def one(t: Column, i: Column) -> Column:
        a = F.regexp_extract(F.trim(t), r"^([0-9]+)\s*-\s*[0-9]+$", 1)
        b = F.regexp_extract(F.trim(t), r"^[0-9]+\s*-\s*([0-9]+)$", 1)
        lo, hi = F.when(a != "", a.cast("int")), F.when(b != "", b.cast("int"))
        ok = lo.isNotNull() & (lo <= hi) & (lo >= 1) & (hi <= total)
        start = F.when(ok, lo).otherwise(F.raise_error(F.concat(F.lit("bad page range "), t)).cast("int"))
        title = F.concat(F.lit("Pages "), a, F.lit("-"), b)
        return F.struct(F.format_string("chapter-%02d", i + 1).alias("id"), title.alias("title"), start.alias("start"), hi.alias("end"))

    return F.transform(F.split(c, ","), one)


def chapters_or(*options: tuple[str, DataFrame], doc: str = "doc") -> DataFrame:
    """For each document the chapters of the first strategy that found any; options: (name, chapters)."""
    rows = None
    for i, (name, df) in enumerate(options):
        each = df.withColumn("strategy", F.lit(name)).withColumn("__p", F.lit(i))
        rows = each if rows is None else rows.unionByName(each)
    best = rows.groupBy(doc).agg(F.min("__p").alias("__p"))
    return rows.join(best, [doc, "__p"]).drop("__p")


Transcriber = Callable[[dict], str]


def transcribe(requests: DataFrame, transcriber: Transcriber, tries: int = 2) -> DataFrame:
    """(request columns, response, error): the injected function over each request row.

    A time-out is tried again once and then reported; other errors are reported at
    once. The function runs on executors and must be safe to repeat.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for row in b.to_dict("records"):
                response = error = None
                for _ in range(tries):
                    try:
                        response, error = transcriber(row), None
                        break
                    except TimeoutError as e:
                        error = f"timeout: {e}"
                    except Exception as e:  # reported as the row's outcome
                        error = f"{type(e).__name__}: {e}"
                        break
                out.append(response)
                errors.append(error)
            yield b.assign(response=out, error=errors)

    fields = ", ".join(f"{c} {t}" for c, t in requests.dtypes)
    return requests.mapInPandas(run, f"{fields}, response string, error string")
