"""Figure widths: joins that find each included graphic's figure and decide its width."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import geometry as G
from quire.functions import labels as L
from quire.latex.lexer import Scan

SIZE_KEYS = frozenset(("width", "height", "totalheight", "scale"))
MAX_PAGE_WIDTH = 14_400.0


def decimal_text(value: float, digits: int) -> str | None:
    """Fixed notation of the exact binary value, half to even, without trailing zeros; None unless positive after rounding."""
    if not value == value or value <= 0 or value == float("inf"):
        return None
    text = format(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN), "f").rstrip("0").rstrip(".")
    return text if float(text) > 0 else None


@F.pandas_udf(StringType())
def _text6(values: pd.Series) -> pd.Series:
    return values.map(lambda x: decimal_text(x, 6))


@F.pandas_udf(StringType())
def _text4(values: pd.Series) -> pd.Series:
    return values.map(lambda x: decimal_text(x, 4))


def option_keys(options: str) -> list[str]:
    """Keys of an option list, cut at commas outside braces."""
    keys, depth, cur, at = [], 0, "", 0
    while at < len(options):
        c = options[at]
        if c == "\\":
            cur += options[at : at + 2]
            at += 2
            continue
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            keys.append(cur)
            cur = ""
        else:
            cur += c
        at += 1
    return [k.partition("=")[0].strip() for k in [*keys, cur] if k.strip()]


def graphics(source: str) -> list[tuple[int, int, int, int | None, str, bool, str]]:
    r"""(number, start, insertion, page, path, sized, options) of every executed \includegraphics.

    The page is that of the last marker before the command; ``insertion`` is where an
    option would go: behind an opening bracket, or before the path's brace.
    """
    scan = Scan(source)
    marks = [(scan.line_starts[line], page) for line, page, body in scan.marker_lines if body]
    out = []
    for i, t in enumerate(scan.tokens):
        if t.kind != "word" or t.name != "includegraphics" or not scan.active(t):
            continue
        j = scan._next(i + 1)
        if j < len(scan.tokens) and scan.source[scan.tokens[j].start] == "*":
            j = scan._next(j + 1)
        options, at = "", None
        if j < len(scan.tokens) and scan.tokens[j].name == "[":
            end = scan._close(j, "[", "]")
            if end is None:
                continue
            at = scan.tokens[j].end
            options = scan.code(at, scan.tokens[end - 1].start)
            j = scan._next(end)
        end = scan._close(j)
        if end is None:
            continue
        path = scan.code(scan.tokens[j].end, scan.tokens[end - 1].start).strip()
        page = next((p for s, p in reversed(marks) if s < t.start), None)
        sized = bool(SIZE_KEYS & set(option_keys(options)))
        out.append((len(out), t.start, scan.tokens[j].start if at is None else at, page, path, sized, options))
    return out


CALL = "n int, start int, insertion int, page int, path string, sized boolean, options string"


def graphics_calls(docs: DataFrame, doc: str = "doc", source: str = "source") -> DataFrame:
    """graphics() of every document, a row for each call; documents without the command never reach Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *call) for d, s in zip(b["doc"], b["source"], strict=True) for call in graphics(s)]
            out = pd.DataFrame(rows, columns=["doc", "n", "start", "insertion", "page", "path", "sized", "options"])
            yield out.astype({"page": "Int32"})

    slim = docs.where(F.contains(F.col(source), F.lit("\\includegraphics"))).select(F.col(doc).alias("doc"), F.col(source).alias("source"))
    return slim.mapInPandas(run, f"doc {dict(slim.dtypes)['doc']}, {CALL}")


def figure_widths(calls: DataFrame, figures: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome and width of every call.

    ``figures``: doc, page, id, bbox; ``pages``: doc, page, width; ``files``: doc, path.
    A figure goes by figures/<prefix and id> and by figures/<id>, with or without
    .png; the first candidate of a call that is known wins. Checks in order: size
    given, page, figure, one bbox, valid bbox, fraction, page width, value, file.
    """
    named = figures.withColumn("safe", L.figure_file(F.col("page"), F.col("id")))
    names = F.array_distinct(F.array(F.concat(F.lit("figures/"), "safe"), F.concat(F.lit("figures/"), F.lower("id"))))
    keyed = named.where("safe IS NOT NULL").select("doc", "page", F.explode(names).alias("key"), "bbox")
    keyed = keyed.groupBy("doc", "page", "key").agg(F.collect_set("bbox").alias("boxes"))
    plain = F.regexp_replace("path", r"(?i)\.(png)$", "")
    found = calls.withColumn("key", plain).join(keyed, ["doc", "page", "key"], "left").join(pages.select("doc", "page", F.col("width").alias("page_width")), ["doc", "page"], "left")
    file = files.select("doc", F.regexp_replace("path", r"(?i)\.(png)$", "").alias("key"), F.lit(True).alias("exists")).distinct()
    found = found.join(file, ["doc", "key"], "left")
    box = F.try_element_at("boxes", F.lit(1))
    found = found.withColumn("box", box).withColumn("valid", G.valid_bbox(F.col("box")))
    found = found.withColumn("fraction", F.when(F.col("valid"), F.col("box")[2])).withColumn("fraction_text", _text6(F.coalesce("fraction", F.lit(0.0))))
    points = F.col("page_width") * F.col("fraction")
    found = found.withColumn("width_bp", _text4(F.coalesce(points, F.lit(0.0))))
    outcome = (
        F.when(F.col("sized"), "explicitSizePreserved")
        .when(F.col("page").isNull(), "noPageContext")
        .when(F.col("boxes").isNull(), "noMatchingFigure")
        .when(F.size("boxes") > 1, "ambiguousFigure")
        .when(~F.col("valid"), "invalidBoundingBox")
        .when(F.col("fraction_text").isNull(), "widthNotRepresentable")
        .when(F.col("page_width").isNull(), "missingPageRecord")
        .when(~F.col("page_width").between(1e-9, MAX_PAGE_WIDTH) | F.col("width_bp").isNull(), "widthNotRepresentable")
        .when(F.col("exists").isNull(), "missingImageFile")
        .otherwise("widthApplied")
    )
    out = found.withColumn("outcome", outcome)
    width = F.when(F.col("outcome") == "widthApplied", F.concat(F.lit("width=\\ifdim\\linewidth<"), "width_bp", F.lit("bp \\linewidth\\else "), "width_bp", F.lit("bp\\fi")))
    return out.select("doc", "n", "start", "insertion", "page", "path", "fraction_text", "width_bp", "outcome", width.alias("width"))


def with_widths(docs: DataFrame, figs: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """``docs`` (doc, source and other columns) with the widths written in, and ``outcomes``: a note for each call.

    A width goes first among a call's options, or into brackets of its own.
    """
    notes = "array<struct<line: int, kind: string, detail: string>>"
    widths = figure_widths(graphics_calls(docs), figs, pages, files)
    edit = F.struct("insertion", "width", "outcome", "path")
    per_doc = widths.groupBy("doc").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    rows = docs.join(per_doc, "doc", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_edited(s, [] if e is None else e) for s, e in zip(b["source"], b["edits"], strict=True)]
            found = [[{"line": s.count("\n", 0, x["insertion"]) + 1, "kind": x["outcome"], "detail": x["path"]} for x in ([] if e is None else e)] for s, e in zip(b["source"], b["edits"], strict=True)]
            yield b.drop(columns=["edits"]).assign(source=out, outcomes=found)

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return rows.mapInPandas(run, f"{kinds}, outcomes {notes}")


def _edited(source: str, edits) -> str:
    pieces, at = [], 0
    for e in edits:
        if e["width"] is None:
            continue
        i = e["insertion"]
        opened = source[i - 1] == "[" and source[i : i + 1] != "{"
        text = e["width"] if opened else f"[{e['width']}]"
        if opened and source[i:].lstrip()[:1] not in ("]", ""):
            text += ","
        pieces += [source[at:i], text]
        at = i
    return "".join([*pieces, source[at:]])
