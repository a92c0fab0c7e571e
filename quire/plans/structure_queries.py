"""Queries on page structure: regions, headings, chapters, layout clusters, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import layout
from quire.operators.joins import clipped
from quire.plans.registry import query
from quire.session import table

TAGS = ("nav", "h1", "p", "li", "footer")


@query(
    "SELECT tag, sum((length(html) - length(replace(html, '<' || tag || '>', ''))) // (length(tag) + 2))::BIGINT AS n FROM pages, (VALUES ('nav'), ('h1'), ('p'), ('li'), ('footer')) t(tag) GROUP BY tag"
)
def region_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by kind, over all pages."""
    counts = F.array(*[F.struct(F.lit(t).alias("tag"), F.regexp_count("html", F.lit(f"<{t}>")).cast("bigint").alias("n")) for t in TAGS])
    return table(spark, sf_dir, "pages").select(F.explode(counts).alias("c")).groupBy("c.tag").agg(F.sum("c.n").alias("n"))


#: What some turns say instead, so that every kind of region and block occurs.
_SAID = {1: "2.1 Lakes", 2: "- a\n- b", 3: "x = ∑", 4: "Figure 2 shore", 5: "Theorem 1. x", 6: "Proof. y", 7: "a = b_1"}
_TEXT = "CASE (conv_id + turn) % 9 " + " ".join(f"WHEN {k} THEN '" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in _SAID.items()) + " ELSE coalesce(text, '') END"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns laid out on a page 600 wide."""
    text = F.coalesce("text", F.lit(""))
    for k, said in _SAID.items():
        text = F.when((F.col("conv_id") + F.col("turn")) % 9 == k, said).otherwise(text)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.alias("text"), (F.col("turn") * 40.0).alias("y"), (F.pmod(F.col("turn") * 97, F.lit(200)) + 20.0).alias("x"),
        (F.pmod(F.length(text), F.lit(400)) + 100.0).alias("w"),
    )


@query(
    rf"""WITH r AS (SELECT conv_id, turn, trim({_TEXT}, chr(32) || chr(9) || chr(10) || chr(13)) AS t, CAST(turn * 40 AS DOUBLE) AS y, CAST(20 + (turn * 97) % 200 AS DOUBLE) AS x, CAST(100 + length({_TEXT}) % 400 AS DOUBLE) AS w FROM conversations),
f AS (SELECT *, abs(x + w / 2 - 300) < 90 AS centred, w < 300 AS narrow, regexp_matches(trim(string_split(t, chr(10))[-1]), '^\([0-9]+\.[0-9]+\)$') AS numbered FROM r)
SELECT conv_id, turn, CASE WHEN y < 30 AND (starts_with(t, 'CHAPTER') OR starts_with(t, 'APPENDIX') OR length(t) < 50) THEN 'header'
 WHEN (regexp_matches(t, '^[0-9]+\.[0-9]+\s*[A-Z]') OR regexp_matches(t, '^[0-9]+\s+[A-Z][a-z]')) AND length(t) < 80 THEN 'heading'
 WHEN (narrow AND centred AND (regexp_matches(t, '[{layout.EQUATION_CHARS}]') OR numbered)) OR (centred AND numbered) THEN 'equation'
 WHEN len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(ltrim(l), '^([0-9]+\.|•|-)'))) >= 2 THEN 'list' ELSE 'text' END AS region FROM f"""
)
def region_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = layout.classify_region(F.col("text"), F.col("x"), F.col("y"), F.col("w"), F.lit(30.0), F.lit(600.0), F.lit(0.0))
    return _regions(spark, sf_dir).select("conv_id", "turn", kind.alias("region"))


@query(
    rf"""WITH r AS (SELECT conv_id, turn, trim({_TEXT}, chr(32) || chr(9) || chr(10) || chr(13)) AS t, len(string_split({_TEXT}, chr(10))) AS n, turn * 40 AS y FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(t), '^(figure |fig\. |table )') THEN 'caption' WHEN regexp_matches(lower(t), '^(theorem|lemma|proposition)') THEN 'theorem'
 WHEN starts_with(lower(t), 'proof') THEN 'proof' WHEN y < 800 * 0.12 AND n <= 3 THEN 'footnote' WHEN n <= 3 AND length(regexp_replace(t, '[^=+*/^_()\[\]{{}}-]', '', 'g')) >= 2 THEN 'equation' ELSE 'text' END AS block FROM r"""
)
def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", "\n", -1))
    return _regions(spark, sf_dir).select("conv_id", "turn", layout.classify_block(F.col("text"), F.col("y"), F.lit(800.0), n).alias("block"))


@query(
    r"""SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS heading, length(regexp_extract(html, '<h1>(.*?)</h1>', 1)) <= 80 AS short FROM pages WHERE regexp_matches(html, '<h1>(.*?)</h1>')"""
)
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").where(F.col("html").rlike("<h1>(.*?)</h1>")).select("page_id", h.alias("heading"), (F.length(h) <= 80).alias("short"))


_CHAPTERS = """s AS (SELECT conv_id, turn + 1 AS page, max(turn + 1) OVER (PARTITION BY conv_id) AS n_pages, role FROM conversations),
c AS (SELECT conv_id, page AS start_page, coalesce(lead(page) OVER (PARTITION BY conv_id ORDER BY page) - 1, n_pages) AS end_page FROM s WHERE role = 'user')"""


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter begins at each user turn and ends before the next."""
    from quire.operators.sequence import range_ends

    n = F.max(F.col("turn") + 1).over(Window.partitionBy("conv_id"))
    pages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("start_page"), n.alias("n_pages"), "role")
    out = range_ends(pages.where("role = 'user'"), ["conv_id"], "start_page", ["start_page"], F.col("n_pages"), name="end_page")
    return out.select("conv_id", "start_page", "end_page")


@query(f"WITH {_CHAPTERS} SELECT * FROM c")
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chapters(spark, sf_dir)


@query(f"WITH {_CHAPTERS} SELECT conv_id, greatest(start_page, 2) AS start_page, least(end_page, 5) AS end_page FROM c WHERE greatest(start_page, 2) <= least(end_page, 5)")
def chapter_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut to pages 2 to 5."""
    return clipped(_chapters(spark, sf_dir), "start_page", "end_page", F.lit(2).cast("bigint"), F.lit(5).cast("bigint"))


@query(f"WITH {_CHAPTERS} SELECT conv_id, page, start_page FROM (SELECT conv_id, start_page, unnest(range(start_page, end_page + 1)) AS page FROM c)")
def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its chapter."""
    from quire.operators.joins import range_expand

    return range_expand(_chapters(spark, sf_dir), "start_page", "end_page", "page").select("conv_id", "page", "start_page")


@query()
def cluster_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of a page folded into blocks."""
    rows = _regions(spark, sf_dir).select("conv_id", "y", F.lit(30.0).alias("height"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), "text", F.lit(600.0).alias("page_width"))
    return layout.strip_clusters(rows, ["conv_id"])


@query(
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 210 / (25.4 / 72) WHEN 1 THEN 842.0 ELSE p_size * 15.0 END AS w, CASE p_partkey % 4 WHEN 0 THEN 297 / (25.4 / 72) WHEN 1 THEN 594.5 ELSE 500 + p_size * 10.0 END AS h, (p_partkey % 8) * 45 AS r FROM part)
SELECT p_partkey, CASE WHEN r IN (90, 270) THEN h ELSE w END AS shown_w, CASE WHEN r IN (90, 270) THEN w ELSE h END AS shown_h, CAST(greatest(1, ceil(w * 144 / 72)) AS BIGINT) AS pixels,
CASE WHEN greatest(abs(least(w, h) - 210 / (25.4 / 72)), abs(greatest(w, h) - 297 / (25.4 / 72))) <= 0.01 THEN 'exactA4' WHEN greatest(abs(least(w, h) - 210 / (25.4 / 72)), abs(greatest(w, h) - 297 / (25.4 / 72))) <= 1.5 THEN 'nearA4' ELSE 'other' END AS class FROM s"""
)
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed sizes, pixels and page classes."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    w = F.when(k == 0, 210 / G.MM_PER_PT).when(k == 1, 842.0).otherwise(size * 15.0)
    h = F.when(k == 0, 297 / G.MM_PER_PT).when(k == 1, 594.5).otherwise(size * 10.0 + 500)
    rows = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), (F.pmod("p_partkey", F.lit(8)) * 45).alias("r"))
    shown = G.displayed(F.col("w"), F.col("h"), F.col("r"))
    return rows.select(
        "p_partkey", shown["width"].alias("shown_w"), shown["height"].alias("shown_h"), G.pixels(F.col("w"), F.lit(144.0)).alias("pixels"), G.a4_class(F.col("w"), F.col("h")).alias("class")
    )


@query(
    """WITH b AS (SELECT vec_id, embedding[1:4] AS b FROM embeddings), f AS (SELECT vec_id, list_transform(b, lambda x: (vec_id % 3) * 4 * abs(CAST(x AS DOUBLE))) AS b FROM b)
SELECT vec_id, b[3] > 0 AND b[4] > 0 AND b[1] + b[3] <= 1 + 1e-6 AND b[2] + b[4] <= 1 + 1e-6 AS valid FROM f"""
)
def bbox_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.transform(F.slice("embedding", 1, 4), lambda x: (F.col("vec_id") % 3) * 4 * F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", G.valid_bbox(box).alias("valid"))


@query(
    """WITH e AS (SELECT n_regionkey AS doc, n_name, row_number() OVER w AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
t AS (SELECT doc, k, CASE WHEN k = n THEN 'A' ELSE k::VARCHAR END AS number, ['Alder', 'Birch', 'Cedar', 'Dogwood', 'Elm', 'Fir', 'Hazel'][(k - 1) % 7 + 1] || ' waters' AS title, k * 6 - 5 AS page FROM e),
s AS (SELECT *, page + doc % 3 + 1 AS start_page, lead(page) OVER (PARTITION BY doc ORDER BY page) + doc % 3 AS nxt FROM t)
SELECT doc, CASE WHEN number = 'A' THEN 'app-a' ELSE 'ch0' || number END AS id, number || ' ' || title AS title, start_page, least(coalesce(nxt, 40), 40) AS end_page FROM s
UNION ALL SELECT DISTINCT doc, 'front-matter', 'Front Matter', 1, doc % 3 + 1 FROM t"""
)
def toc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents of regions, whose chapters are nations, in one-line and spread forms; their chapters' page ranges."""
    w = Window.partitionBy("doc").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("doc"), "n_nationkey", "n_name")
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("doc")))
    number = F.when(F.col("k") == F.col("n"), "A").otherwise(F.col("k").cast("string"))
    trees = F.array(*map(F.lit, ("Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Hazel")))
    title = F.concat(F.element_at(trees, (F.col("k") - 1) % 7 + 1), F.lit(" waters"))
    page = (F.col("k") * 6 - 5).cast("string")
    spread = F.col("doc") % 2 == 1
    line = F.when(spread & (F.col("k") % 2 == 0), F.concat_ws("\n", number, title, page)).when(spread, F.concat(number, F.lit("\n"), title, F.lit(" ..... "), page))
    line = line.when(F.col("k") % 3 == 0, F.concat_ws(" ", number, title, page)).otherwise(F.concat(number, F.lit(" "), title, F.lit(" ....... "), page))
    line = F.when(spread, line).otherwise(F.concat(line, F.lit("\n"), F.col("k"), F.lit(".1 Details .... "), page))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]), "\n")
    contents = rows.groupBy("doc").agg(F.concat(F.lit("Contents\n"), lines).alias("text")).select("doc", F.lit(1).cast("bigint").alias("page"), "text")
    body = contents.select("doc", (F.col("doc") % 3 + 2).alias("page"), F.repeat(F.lit("words of the first chapter "), F.lit(10)).alias("text"))
    pages = contents.unionByName(body)
    entries = layout.toc_entries(contents, "doc", "page", "text")
    total = pages.select("doc").distinct().withColumn("n_pages", F.lit(40).cast("bigint"))
    first = entries.where("content_page <= 2").groupBy("doc").agg(F.min("content_page").alias("content_page"))
    offsets = layout.page_offset(pages, "doc", "page", "text", first, total).join(total, "doc")
    return layout.chapter_ranges(entries, "doc", offsets)
