"""Verdicts on a document as a whole: its source, its typography, its chapters by headings or outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.geometry import paper_class
from quire.operators import votes
from quire.operators.joins import clipped, snapped

#: Fixed values of the text layer: pages looked at, characters that make a page one with text, and the share below which it is absent.
TEXT_PAGES, TEXT_CHARS, TEXT_SHARE, NO_TEXT_SCORE = 5, 20, 0.3, 0.6
#: Model names by prefix, and what others are.
BACKENDS, DEFAULT_BACKEND = (("claude", "claude"), ("gemini", "gemini")), "codex"
#: Body sizes that a class offers, and the one without any text.
BODY_SIZES, BODY_DEFAULT = [10.0, 11.0, 12.0], 11.0
FALLBACK_12 = ("times", "palatino")
#: Fixed values of headings: prefixes, section pattern, and the top share, height and length of a likely title.
HEADING_WORDS, SECTION = ("chapter ", "appendix "), r"^[0-9]+(\.[0-9]+)?\s+[A-Z]"
TITLE_TOP, TITLE_HEIGHT, TITLE_CHARS = 0.72, 18.0, 80
MATH_FONTS = ("CMMI", "CMSY", "CMEX", "CMMIB", "CMBSY", "MSBM", "MSAM")


def text_layer(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, text_share, has_text) over a document's first pages; ``pages``: doc, page, text."""
    first = pages.withColumn("__n", F.row_number().over(Window.partitionBy(doc).orderBy("page"))).where(F.col("__n") <= TEXT_PAGES)
    there = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r"))) > TEXT_CHARS
    share = first.groupBy(doc).agg((F.count_if(there) / F.count("*")).alias("text_share"))
    return share.withColumn("has_text", F.col("text_share") >= TEXT_SHARE)


def source_verdict(info: DataFrame, fonts: DataFrame, pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, format, confidence, engine): evidence of metadata, fonts and text layer summed by format.

    ``info``: doc, creator, producer; ``fonts``: doc, font, n. The best format wins, the first
    by name of equals; the confidence is its score, at most 1; only latex has an engine.
    """
    said = info.select(doc, votes.source_from_metadata(F.col("creator"), F.col("producer")).alias("m"))
    engines = said.select(doc, F.col("m.engine").alias("engine"))
    none = said.join(fonts.select(doc).distinct(), doc, "left_anti").select(doc, F.lit("scanned").alias("format"), F.lit(0.4).alias("score"))
    absent = text_layer(pages, doc).where("NOT has_text").select(doc, F.lit("scanned").alias("format"), F.lit(NO_TEXT_SCORE).alias("score"))
    evidence = said.select(doc, "m.format", "m.score").unionByName(votes.source_from_fonts(fonts, [doc])).unionByName(none).unionByName(absent)
    # Sums of doubles depend on their order: hundredths are exact.
    best = votes.arg_max(evidence.withColumn("score", F.round(F.col("score") * 10000).cast("bigint")), [doc], "format", F.sum("score"))
    confidence = F.least(F.lit(1.0), F.col("score") / 10000)
    engine = F.when(F.col("format") == "latex", F.col("engine"))
    return best.join(engines, doc, "left").select(doc, "format", confidence.alias("confidence"), engine.alias("engine"))


def sampled_fonts(fonts: DataFrame, n_pages: DataFrame, doc: str = "doc", samples: int = 20) -> DataFrame:
    """(doc, font, n): font uses on every k-th page, k = max(1, pages / samples); ``fonts``: doc, page (from 0), font."""
    step = F.greatest(F.lit(1), F.floor(F.col("n_pages") / samples))
    return fonts.join(n_pages, doc).where(F.pmod(F.col("page"), step) == 0).groupBy(doc, "font").agg(F.count("*").alias("n"))


def body_size(runs: DataFrame, n_pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, size): the size, to half points, of most characters on the 20 pages from min(20, n / 4) on; the smaller of equals.

    ``runs``: doc, page (from 0), size, chars."""
    first = F.least(F.lit(20), F.floor(F.col("n_pages") / 4))
    inner = runs.join(n_pages, doc).where((F.col("page") >= first) & (F.col("page") < first + 20))
    found = votes.weighted_mode(inner, [doc], F.floor(F.col("size") * 2 + 0.5) / 2, F.col("chars"), "size")
    return n_pages.select(doc).join(found.select(doc, "size"), doc, "left").withColumn("size", F.coalesce("size", F.lit(BODY_DEFAULT)))


def fallback_size(family: Column) -> Column:
    """The body size that a family suggests where no run says it."""
    return F.when(family.isin(*FALLBACK_12), 12.0).otherwise(BODY_DEFAULT)


def inches(value: Column) -> Column:
    """A length to hundredths of an inch, without needless zeros."""
    text = F.format_string("%.2f", F.round(value, 2))
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit("in"))


def geometry_string(left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """Options of a geometry package; sides that aren't known are left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), inches(c))) for name, c in (("left", left), ("right", right), ("top", top), ("bottom", bottom))]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ",")


def typography(sizes: DataFrame, fonts: DataFrame, runs: DataFrame, margins: DataFrame, doc: str = "doc") -> DataFrame:
    """A profile of each document that has pages: paper, family, encoding, body size and margins.

    ``sizes``: doc, page (from 0), width, height; ``fonts``, ``runs`` as above; ``margins``: doc, left, right, top, bottom."""
    n_pages = sizes.groupBy(doc).agg(F.count("*").alias("n_pages"))
    paper = sizes.where("page = 0").select(doc, paper_class(F.col("width"), F.col("height")).alias("paper"))
    counts = sampled_fonts(fonts, n_pages, doc)
    named = counts.withColumn("family", votes.font_family(F.col("font"))).where("family IS NOT NULL")
    family = votes.arg_max(named, [doc], "family", F.sum("n")).select(doc, "family")
    encoding = votes.font_encoding(counts, [doc]).select(doc, "encoding")
    body = body_size(runs, n_pages, doc)
    out = n_pages.join(paper, doc, "left").join(family, doc, "left").join(encoding, doc, "left").join(body, doc).join(margins, doc, "left")
    return out.select(
        doc, F.coalesce("paper", F.lit("custom")).alias("paper"), F.coalesce("family", F.lit("unknown")).alias("family"), F.coalesce("encoding", F.lit("T1")).alias("encoding"),
        snapped(F.col("size"), BODY_SIZES).alias("body_size"), geometry_string(*map(F.col, ("left", "right", "top", "bottom"))).alias("geometry"),
    )


def is_math_font(name: Column) -> Column:
    up = F.upper(T.without_subset_prefix(name))
    return up.rlike(f"^({'|'.join(MATH_FONTS)})") | up.contains("MATH")


def backend_of(model: Column) -> Column:
    low, out = F.lower(model), F.when(F.lit(False), "")
    for prefix, name in BACKENDS:
        out = out.when(low.startswith(prefix), name)
    return out.otherwise(DEFAULT_BACKEND)


def reading_order(df: DataFrame, keys: list[str], top: str, left: str, name: str = "ord") -> DataFrame:
    """Rows from the top (large) down, and from the left within a band of one point.

    Tops are rounded to whole points: "equal within a point" alone is no order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.floor(F.col(top) + 0.5)), left)
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))


def long_segments(dx: Column, dy: Column, least: float = 20.0) -> Column:
    """``struct<length, horizontal, vertical>`` of a segment longer than 20 points, else null."""
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length > least, F.struct(length.alias("length"), (F.abs(dy) < 1).alias("horizontal"), (F.abs(dx) < 1).alias("vertical")))


def rectangle(x: Column, y: Column, w: Column, h: Column, least: float = 10.0) -> Column:
    """A rectangle with positive sides, both over 10 points, else null."""
    box = F.struct(F.least(x, x + w).alias("x"), F.least(y, y + h).alias("y"), F.abs(w).alias("width"), F.abs(h).alias("height"))
    return F.when((F.abs(w) > least) & (F.abs(h) > least), box)


def applied(m: Column, x: Column, y: Column) -> Column:
    """A point under an affine transform (a, b, c, d, e, f)."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def composed(m: Column, n: Column) -> Column:
    """The transform that first applies ``m``, then ``n``."""
    linear = [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3]]
    return F.array(*linear, m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


# --- chapters ---


def heading_candidates(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, title): the first heading of each page; ``blocks``: doc, page, ord, type, text, y, height, page_height.

    y counts from the bottom. A text or theorem block counts if its first line starts like a
    chapter or numbered section, or is short, tall and near the top of the page."""
    t = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r"))
    line = F.trim(F.substring_index(t, "\n", 1), F.lit(" \t\r"))
    rows = blocks.where(F.col("type").isin("text", "theorem")).withColumn("title", line).where("title != ''")
    low = F.lower("title")
    chapter = low.startswith(HEADING_WORDS[0]) | low.startswith(HEADING_WORDS[1]) | F.col("title").rlike(SECTION)
    tall = (F.col("y") + F.col("height") > F.col("page_height") * TITLE_TOP) & (F.col("height") >= TITLE_HEIGHT) & (F.length("title") <= TITLE_CHARS)
    return rows.where(chapter | tall).groupBy(doc, "page").agg(F.min_by("title", "ord").alias("title"))


def chapters_from_starts(starts: DataFrame, pages: DataFrame, fallback: str, doc: str = "doc") -> DataFrame:
    """(doc, id, title, start_page, end_page) from (doc, page, title): a chapter ends before the next start, the last with the document.

    ``pages``: doc, first_page, last_page. Ids are slugs of the titles, or ``fallback`` and a number."""
    w = Window.partitionBy(doc).orderBy("page", "title")
    n = F.row_number().over(w)
    following = F.lead("page").over(w)
    rows = starts.join(pages, doc).where("page BETWEEN first_page AND last_page").withColumn("n", n).withColumn("following", following)
    end = F.coalesce(F.greatest(F.col("page"), F.col("following") - 1), F.col("last_page"))
    slug = F.coalesce(F.nullif(T.slug(F.col("title"), ""), F.lit("")), F.format_string(f"{fallback}-%02d", F.col("n").cast("int")))
    out = rows.select(doc, slug.alias("id"), "title", F.col("page").alias("start_page"), end.alias("end_page"), "first_page", "last_page")
    return clipped(out, "start_page", "end_page", F.col("first_page"), F.col("last_page")).drop("first_page", "last_page")


def single_chapter(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """One chapter over all pages; ``pages``: doc, first_page, last_page."""
    return pages.select(doc, F.lit("chapter-all").alias("id"), F.lit("Document").alias("title"), F.col("first_page").alias("start_page"), F.col("last_page").alias("end_page"))


def outline_rows(nodes: DataFrame, root, most_levels: int = 64) -> DataFrame:
    """(node, depth, path) of a tree, level by level; ``nodes``: node, parent; paths sort in pre-order.

    Every level is a table in the shared folder, so the plan doesn't grow with the depth and
    no limit of recursive queries applies; cycles end at ``most_levels`` with an error."""
    from quire.session import written

    level = written(nodes.where(F.col("parent").isNull() if root is None else F.col("parent") == root).select("node", F.lit(0).alias("depth"), F.col("node").cast("string").alias("path")), "outline")
    out = level
    for depth in range(1, most_levels + 1):
        up = level.select(F.col("node").alias("parent"), "path")
        level = nodes.join(up, "parent").select("node", F.lit(depth).alias("depth"), F.concat("path", F.lit("/"), F.col("node").cast("string")).alias("path"))
        level = written(level, "outline")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the outline is deeper than {most_levels} levels, or has a cycle")
