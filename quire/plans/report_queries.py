"""Queries that compare two versions of a document, and verdicts on documents as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.latex import passes, preamble, udfs
from quire.operators import detect, report, votes
from quire.plans.registry import query
from quire.session import table

_UNIFIED = "text"
for _old, _new in T.LIGATURES + T.SYMBOLS:
    _quoted = _new.replace("'", "''")
    _UNIFIED = f"replace({_UNIFIED}, '{_old}', '{_quoted}')"
#: The normalized tokens of ``text``, as the operators make them.
_TOKENS = rf"list_transform(list_filter(string_split_regex({_UNIFIED}, '[\s\x{{0085}}\p{{Z}}]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{M}}\p{{N}}]')), lambda w: lower(w))"

_SIDES = """t AS (SELECT conv_id AS doc, turn AS page, role, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' ﬁne ﬂow a−b ≤c ″q' ELSE '' END AS text FROM conversations),
pa AS (SELECT doc, page, text FROM t),
pb AS (SELECT doc, page, CASE WHEN (doc + page) % 5 = 0 THEN left(text, CAST(length(text) // 2 AS BIGINT)) ELSE replace(text, 'ﬁ', 'fi') END AS text FROM t WHERE (doc + page) % 11 != 0),
ca AS (SELECT doc, row_number() OVER w AS chapter, left(text, 35) AS title, page AS start_page, coalesce(lead(page) OVER w, n) AS end_page
  FROM (SELECT *, max(page) OVER (PARTITION BY doc) + 1 AS n FROM t) WHERE role = 'user' WINDOW w AS (PARTITION BY doc ORDER BY page)),
cb AS (SELECT * FROM ca WHERE (doc + chapter) % 4 != 0 UNION ALL SELECT DISTINCT doc, 99, 'extra', 0, 1 FROM t WHERE doc % 3 = 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages and chapters of conversations (user turns open chapters), and of an altered copy."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("doc"), F.col("turn").cast("bigint").alias("page"), "role",
        F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, " ﬁne ﬂow a−b ≤c ″q").otherwise("")).alias("text"),
    )
    a = rows.select("doc", "page", "text")
    half = F.expr("left(text, cast(floor(length(text) / 2) AS int))")
    b = a.where((F.col("doc") + F.col("page")) % 11 != 0).withColumn("text", F.when((F.col("doc") + F.col("page")) % 5 == 0, half).otherwise(F.replace("text", F.lit("ﬁ"), F.lit("fi"))))
    w = Window.partitionBy("doc").orderBy("page")
    last = F.max("page").over(Window.partitionBy("doc")) + 1
    chapters = rows.withColumn("n", last).where("role = 'user'").select(
        "doc", F.row_number().over(w).cast("bigint").alias("chapter"), F.left("text", F.lit(35)).alias("title"), F.col("page").alias("start_page"), F.coalesce(F.lead("page").over(w), "n").alias("end_page")
    )
    extra = rows.where("doc % 3 = 0").select("doc").distinct().selectExpr("doc", "99L AS chapter", "'extra' AS title", "0L AS start_page", "1L AS end_page")
    return a, chapters, b, chapters.where((F.col("doc") + F.col("chapter")) % 4 != 0).unionByName(extra)


_REPORT = rf"""{_SIDES},
wa AS (SELECT DISTINCT doc, chapter, unnest({_TOKENS}) AS w FROM ca JOIN pa USING (doc) WHERE page >= start_page AND page < end_page),
wb AS (SELECT DISTINCT doc, chapter, unnest({_TOKENS}) AS w FROM cb JOIN pb USING (doc) WHERE page >= start_page AND page < end_page),
na AS (SELECT doc, chapter, count(*) AS n FROM wa GROUP BY ALL), nb AS (SELECT doc, chapter, count(*) AS n FROM wb GROUP BY ALL),
o AS (SELECT doc, chapter, count(*) AS o FROM wa JOIN wb USING (doc, chapter, w) GROUP BY ALL),
r AS (SELECT coalesce(ca.doc, cb.doc) AS doc, coalesce(ca.chapter, cb.chapter) AS chapter, coalesce(ca.title, cb.title) AS title,
  coalesce(ca.end_page - ca.start_page, 0) AS orig_pages, coalesce(cb.end_page - cb.start_page, 0) AS repr_pages,
  CASE WHEN cb.doc IS NULL THEN 'missing_in_reproduced' WHEN ca.doc IS NULL THEN 'missing_in_original' END AS status
  FROM ca FULL JOIN cb ON ca.doc = cb.doc AND ca.chapter = cb.chapter),
rep AS (SELECT r.doc, r.chapter, title, orig_pages, repr_pages, CASE WHEN status IS NOT NULL THEN 0.0 WHEN coalesce(na.n, 0) = 0 THEN CAST(coalesce(nb.n, 0) = 0 AS INT) ELSE round(coalesce(o, 0) / na.n, 4) END AS word_coverage, status
  FROM r LEFT JOIN na ON r.doc = na.doc AND r.chapter = na.chapter LEFT JOIN nb ON r.doc = nb.doc AND r.chapter = nb.chapter LEFT JOIN o ON r.doc = o.doc AND r.chapter = o.chapter)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chapter_report(*_sides(spark, sf_dir))


@query(f"WITH {_REPORT} SELECT * FROM rep")
def chapter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a document by chapter: pages, word coverage, missing and extra chapters."""
    return _report(spark, sf_dir)


@query(f"""WITH {_REPORT} SELECT doc, coalesce(avg(word_coverage) FILTER (status IS NULL), 0) AS average, count(*) FILTER (status IS NULL) AS valid_chapters,
  coalesce(list(chapter ORDER BY chapter) FILTER (status = 'missing_in_reproduced'), []) AS missing FROM rep GROUP BY doc""")
def chapter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chapter_summary(_report(spark, sf_dir))


_SEGMENTS = rf"""{_SIDES},
both_ AS (SELECT ca.doc, ca.chapter, ca.start_page AS a0, cb.start_page AS b0, ca.end_page - ca.start_page AS na, cb.end_page - cb.start_page AS nb, greatest(1, (ca.end_page - ca.start_page) // 2) AS k FROM ca JOIN cb ON ca.doc = cb.doc AND ca.chapter = cb.chapter),
s AS (SELECT *, unnest(range(k)) AS segment FROM both_),
g AS (SELECT doc, chapter, segment, a0 + segment * na // k AS a_start, a0 + (segment + 1) * na // k AS a_end, b0 + segment * nb // k AS b_start, b0 + (segment + 1) * nb // k AS b_end, a0 FROM s),
wa AS (SELECT DISTINCT doc, chapter, segment, unnest({_TOKENS}) AS w FROM g JOIN pa USING (doc) WHERE page >= a_start AND page < a_end),
wb AS (SELECT DISTINCT doc, chapter, segment, unnest({_TOKENS}) AS w FROM g JOIN pb USING (doc) WHERE page >= b_start AND page < b_end),
na_ AS (SELECT doc, chapter, segment, count(*) AS n FROM wa GROUP BY ALL), nb_ AS (SELECT doc, chapter, segment, count(*) AS n FROM wb GROUP BY ALL),
o AS (SELECT doc, chapter, segment, count(*) AS o FROM wa JOIN wb USING (doc, chapter, segment, w) GROUP BY ALL),
c AS (SELECT g.*, 'pp ' || (a_start - a0 + 1) || '-' || (a_end - a0) AS label, CASE WHEN coalesce(na_.n, 0) = 0 THEN CAST(coalesce(nb_.n, 0) = 0 AS INT) ELSE round(coalesce(o, 0) / na_.n, 4) END AS word_coverage
  FROM g LEFT JOIN na_ USING (doc, chapter, segment) LEFT JOIN nb_ USING (doc, chapter, segment) LEFT JOIN o USING (doc, chapter, segment))"""


@query(f"WITH {_SEGMENTS} SELECT doc, chapter, arg_min(word_coverage, (word_coverage, segment)) AS word_coverage, arg_min(label, (word_coverage, segment)) AS label FROM c GROUP BY doc, chapter")
def worst_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of both versions cut into equal segments of about two pages; the one that is covered least."""
    a, ca, b, cb = _sides(spark, sf_dir)
    keys = ["doc", "chapter", "segment"]
    cut = report.segments(ca, cb, keys[:2], pages=2)
    side = lambda s: cut.select(*keys, F.col(f"{s}_start").alias("start_page"), F.col(f"{s}_end").alias("end_page"))
    words = report.range_words(a, side("a"), keys, "wa").drop("start_page", "end_page").join(report.range_words(b, side("b"), keys, "wb").drop("start_page", "end_page"), keys)
    covered = words.join(cut.select(*keys, "label"), keys).withColumn("word_coverage", F.round(T.set_coverage(F.col("wa"), F.col("wb")), 4))
    return report.worst(covered, keys[:2], "word_coverage", "segment", ["label"])


#: Names of fonts, some of them subsets, and what each supplier's parts are set in.
FONTS = ("ABCDEF+CMR10", "CMBX12", "SFRM1000", "Times-Roman", "Calibri", "CMMI10", "LMRoman10-Regular", "Helvetica", "QWERTY+CMR10")
_FONT = "['" + "', '".join(FONTS) + "'][CAST(l_partkey % 9 + 1 AS INT)]"


def _font(key: str = "l_partkey") -> Column:
    return F.element_at(F.array(*map(F.lit, FONTS)), (F.col(key) % 9 + 1).cast("int"))


_FONT_PAGES = rf"""f AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey AS page, {_FONT} AS font FROM lineitem),
c AS (SELECT doc, regexp_replace(font, '^[^+]*\+', '') AS font, count(*) AS n FROM f GROUP BY ALL)"""


def _font_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.font_pages(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), _font().alias("font")))


@query(f"WITH {_FONT_PAGES} SELECT * FROM c")
def font_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many pages (orders) of a document (supplier) each font stands."""
    return _font_pages(spark, sf_dir)


@query(rf"WITH {_FONT_PAGES} SELECT doc, upper(regexp_replace(string_split(font, '-')[1], '[0-9]+$', '')) AS family, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.font_families(_font_pages(spark, sf_dir))


_SIZES = """o AS (SELECT o_custkey % 200 AS doc, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS page, o_orderkey AS k FROM orders),
a AS (SELECT doc, page, 500 + CAST(k % 3 AS DOUBLE) AS width, 700 + CAST(k % 2 AS DOUBLE) AS height FROM o),
b AS (SELECT doc, page, CASE WHEN doc % 3 != 0 AND page % 7 < 2 THEN width + 0.0001 ELSE width END AS width, height FROM a WHERE page < 40)"""


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("doc"), F.col("o_orderkey").alias("k"))
    rows = rows.withColumn("page", F.row_number().over(Window.partitionBy("doc").orderBy("k")).cast("bigint"))
    a = rows.select("doc", "page", ((F.col("k") % 3).cast("double") + 500).alias("width"), ((F.col("k") % 2).cast("double") + 700).alias("height"))
    wider = F.when((F.col("doc") % 3 != 0) & (F.col("page") % 7 < 2), F.col("width") + 0.0001).otherwise(F.col("width"))
    return a, a.where("page < 40").withColumn("width", wider)


@query(
    f"""WITH {_SIZES}, d AS (SELECT doc, page FROM a JOIN b USING (doc, page) WHERE a.width != b.width OR a.height != b.height),
r AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS run FROM d),
g AS (SELECT doc, min(page) AS lo, max(page) AS hi FROM r GROUP BY doc, run),
v AS (SELECT doc, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS t FROM g GROUP BY doc)
SELECT DISTINCT a.doc, coalesce('MISMATCH (pages ' || t || ')', 'OK') AS verdict, coalesce((SELECT list(page ORDER BY page) FROM d WHERE d.doc = a.doc), []) AS pages FROM a JOIN b USING (doc, page) LEFT JOIN v ON v.doc = a.doc"""
)
def size_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose size differs between two versions, and the verdict."""
    return report.size_mismatches(*_sizes(spark, sf_dir))


@query(
    f"""WITH {_SIZES}, s AS (SELECT DISTINCT doc, width, height FROM (SELECT doc, width, height FROM a UNION ALL SELECT doc, width, height FROM b)), n AS (SELECT doc, count(*) AS n FROM s GROUP BY doc),
l AS (SELECT doc, 2 AS d, count(DISTINCT (format('{{:.2f}}', width), format('{{:.2f}}', height))) AS k FROM s GROUP BY doc UNION ALL SELECT doc, 4, count(DISTINCT (format('{{:.4f}}', width), format('{{:.4f}}', height))) FROM s GROUP BY doc)
SELECT doc, CAST(min(d) AS INT) AS decimals FROM l JOIN n USING (doc) WHERE k = n GROUP BY doc"""
)
def min_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest decimals that tell all page sizes of a document apart."""
    a, b = _sizes(spark, sf_dir)
    return report.min_precision(a.unionByName(b))


_MAKERS = (("pdfTeX-1.40", "x"), ("Microsoft Word", "y"), ("none", "LuaTeX"), ("TeX", "z"), ("LibreOffice 7", "q"), ("Typst 0.1", "q"), ("Adobe InDesign", "q"), (None, "Pages"), ("a", "b"), (None, None))
_CREATORS = ", ".join("NULL" if c is None else f"'{c}'" for c, _ in _MAKERS)
_PRODUCERS = ", ".join("NULL" if p is None else f"'{p}'" for _, p in _MAKERS)
_SAID = " ".join(
    f"WHEN {'lower(creator)' if side == 0 else 'lower(producer)'} ~ '.*({pattern}).*'" + (f" AND NOT contains({'lower(creator)' if side == 0 else 'lower(producer)'}, 'text')" if pattern == "tex" else "") + f" THEN {{'f': '{f}', 'e': '{e}', 's': {round(s * 10000)}}}"
    for a, b in votes.METADATA_KINDS for side in (0, 1) for pattern, f, e, s in votes.METADATA_RULES[a:b]
)
_LATEX = "|".join(votes.LATEX_PREFIXES)
_OFFICE = "|".join(w for w in votes.OFFICE_WORDS if " " not in w)


@query(
    rf"""WITH i AS (SELECT s_suppkey AS doc, [{_CREATORS}][CAST(s_suppkey % 10 + 1 AS INT)] AS creator, [{_PRODUCERS}][CAST(s_suppkey % 10 + 1 AS INT)] AS producer FROM supplier),
m AS (SELECT doc, CASE {_SAID} ELSE {{'f': 'unknown', 'e': 'unknown', 's': 0}} END AS m FROM i),
f AS (SELECT l_suppkey AS doc, upper({_FONT}) AS font, count(*) AS n FROM lineitem WHERE l_suppkey % 4 != 0 AND NOT (l_suppkey % 3 = 0 AND l_partkey % 9 NOT IN (4, 7)) GROUP BY ALL),
c AS (SELECT doc, coalesce(sum(n) FILTER (regexp_matches(font, '^({_LATEX})')), 0) AS latex, coalesce(sum(n) FILTER (regexp_matches(replace(font, '-', ''), '{_OFFICE}')), 0) AS office, sum(n) AS total FROM f GROUP BY doc),
fs AS (SELECT doc, CASE WHEN latex / total > 0.3 THEN 'latex' WHEN office > 0 THEN 'word' ELSE 'unknown' END AS f, CASE WHEN latex / total > 0.3 THEN CAST(round(least(0.8, latex / total) * 10000) AS BIGINT) WHEN office > 0 THEN 6000 ELSE 0 END AS s FROM c),
p AS (SELECT ps_suppkey AS doc, CASE WHEN ps_suppkey % 5 < 2 AND ps_partkey % 3 > 0 THEN 'short' ELSE repeat('long text ', 3) END AS text, row_number() OVER (PARTITION BY ps_suppkey ORDER BY ps_partkey) AS n FROM (SELECT DISTINCT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey FROM lineitem)),
t AS (SELECT doc FROM p WHERE n <= 5 GROUP BY doc HAVING count(*) FILTER (length(trim(text)) > 20) / count(*) < 0.3),
e AS (SELECT doc, m.f AS f, m.s AS s FROM m UNION ALL SELECT * FROM fs UNION ALL SELECT doc, 'scanned', 4000 FROM i WHERE doc NOT IN (SELECT doc FROM f) UNION ALL SELECT doc, 'scanned', 6000 FROM t),
g AS (SELECT doc, f, sum(s) AS s FROM e GROUP BY ALL)
SELECT doc, arg_min(f, (-s, f)) AS format, least(1.0, max(s) / 10000) AS confidence, CASE WHEN arg_min(f, (-s, f)) = 'latex' THEN (SELECT any_value(m.m.e) FROM m WHERE m.doc = g.doc) END AS engine FROM g GROUP BY doc"""
)
def source_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of each document (supplier) from its metadata, its fonts and its text layer."""
    at = (F.col("doc") % 10 + 1).cast("int")
    info = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"))
    info = info.withColumn("creator", F.element_at(F.array(*[F.lit(c) for c, _ in _MAKERS]), at)).withColumn("producer", F.element_at(F.array(*[F.lit(p) for _, p in _MAKERS]), at))
    items = table(spark, sf_dir, "lineitem")
    set_in = items.where("l_suppkey % 4 != 0 AND NOT (l_suppkey % 3 = 0 AND l_partkey % 9 NOT IN (4, 7))")
    fonts = set_in.groupBy(F.col("l_suppkey").alias("doc"), _font().alias("font")).agg(F.count("*").alias("n"))
    pages = items.select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("page")).distinct()
    pages = pages.withColumn("text", F.when((F.col("doc") % 5 < 2) & (F.col("page") % 3 > 0), "short").otherwise("long text " * 3))
    return detect.source_verdict(info, fonts, pages)


@query(
    rf"""WITH o AS (SELECT o_custkey % 50 AS doc, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS page, o_orderkey AS k, count(*) OVER (PARTITION BY o_custkey % 50) AS n FROM orders),
f AS (SELECT doc, page, n, ['Times-Roman', 'ABCDEF+CMR10', 'SFRM1000', 'Unknown', 'Palatino-X'][CAST((doc + k % 2) % 5 + 1 AS INT)] AS font FROM o),
c AS (SELECT doc, upper(regexp_replace(font, '^[^+]*\+', '')) AS font, count(*) AS n FROM f WHERE page % greatest(1, n // 20) = 0 GROUP BY ALL),
v AS (SELECT doc, CASE WHEN font ~ '(CMR|SFRM).*' THEN 'computerModern' WHEN font ~ '.*TIMES.*' THEN 'times' WHEN font ~ '.*PALATINO.*' THEN 'palatino' END AS family, sum(n) AS n FROM c GROUP BY ALL),
b AS (SELECT doc, arg_min(family, (-n, family)) AS family FROM v WHERE family IS NOT NULL GROUP BY doc),
e AS (SELECT doc, coalesce(sum(n) FILTER (starts_with(font, 'SFRM')), 0) AS t1, coalesce(sum(n) FILTER (starts_with(font, 'CMR')), 0) AS ot1 FROM c GROUP BY doc),
r AS (SELECT doc, floor((9 + k % 9 * 0.4) * 2 + 0.5) / 2 AS size, sum(1 + k % 50) AS w FROM o WHERE page >= least(20, n // 4) AND page < least(20, n // 4) + 20 GROUP BY ALL),
z AS (SELECT doc, arg_min(size, (-w, size)) AS size FROM r GROUP BY doc)
SELECT DISTINCT o.doc, CASE WHEN o.doc % 3 = 0 THEN 'a4paper' WHEN o.doc % 3 = 1 THEN 'letterpaper' ELSE 'custom' END AS paper, coalesce(family, 'unknown') AS family, CASE WHEN ot1 > 0 AND t1 < ot1 THEN 'OT1' ELSE 'T1' END AS encoding,
  CASE WHEN size <= 10.5 THEN 10.0 WHEN size <= 11.5 THEN 11.0 ELSE 12.0 END AS body_size, CASE WHEN o.doc % 4 = 0 THEN 'right=1.5in' ELSE 'left=1in,right=1.5in,top=' || [0.75, 1.0, 1.25][CAST(o.doc % 3 + 1 AS INT)]::DOUBLE::VARCHAR.regexp_replace('\.0$', '') || 'in,bottom=0.33in' END AS geometry
FROM o LEFT JOIN b ON o.doc = b.doc LEFT JOIN e ON o.doc = e.doc LEFT JOIN z ON o.doc = z.doc"""
)
def typography_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper, family, encoding, body size and margins of documents whose pages are orders."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc"), F.col("o_orderkey").alias("k"))
    rows = rows.withColumn("page", (F.row_number().over(Window.partitionBy("doc").orderBy("k")) - 1).cast("bigint"))
    third = F.col("doc") % 3
    width, height = F.when(third == 0, 595.0).when(third == 1, 612.0).otherwise(300.0), F.when(third == 0, 842.0).when(third == 1, 792.0).otherwise(300.0)
    sizes = rows.select("doc", "page", width.alias("width"), height.alias("height"))
    names = F.array(*map(F.lit, ("Times-Roman", "ABCDEF+CMR10", "SFRM1000", "Unknown", "Palatino-X")))
    fonts = rows.select("doc", "page", F.element_at(names, ((F.col("doc") + F.col("k") % 2) % 5 + 1).cast("int")).alias("font"))
    runs = rows.select("doc", "page", (F.col("k") % 9 * 0.4 + 9).alias("size"), (F.col("k") % 50 + 1).alias("chars"))
    known = F.col("doc") % 4 != 0
    top = F.element_at(F.array(F.lit(0.75), F.lit(1.0), F.lit(1.25)), (third + 1).cast("int"))
    margins = rows.select("doc").distinct().select(
        "doc", F.when(known, 1.0).alias("left"), F.lit(1.499).alias("right"), F.when(known, top).alias("top"), F.when(known, 0.3333).alias("bottom")
    )
    return detect.typography(sizes, fonts, runs, margins)


_BLOCKS = r"""b AS (SELECT conv_id AS doc, turn // 2 + 1 AS page, turn AS ord, CASE WHEN turn % 7 = 5 THEN 'equation' ELSE 'text' END AS type, CASE WHEN turn % 5 = 0 THEN 'Chapter ' || turn || chr(10) || coalesce(text, '') WHEN turn % 5 = 1 THEN turn || '.1 Aims' WHEN turn % 5 = 2 THEN '  ' ELSE coalesce(text, '') END AS text, (turn % 4) * 200.0 AS y, 10.0 + turn % 3 * 6 AS height FROM conversations),
h AS (SELECT doc, page, ord, trim(string_split(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10))[1], chr(32) || chr(9) || chr(13)) AS title, y, height FROM b WHERE type = 'text'),
c AS (SELECT doc, page, arg_min(title, ord) AS title FROM h WHERE title != '' AND (starts_with(lower(title), 'chapter ') OR starts_with(lower(title), 'appendix ') OR regexp_matches(title, '^[0-9]+(\.[0-9]+)?\s+[A-Z]') OR (y + height > 800 * 0.72 AND height >= 18 AND length(title) <= 80)) GROUP BY doc, page),
p AS (SELECT doc, min(page) AS first_page, max(page) AS last_page FROM b GROUP BY doc)"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    said = F.when(turn % 5 == 0, F.concat(F.lit("Chapter "), turn, F.lit("\n"), text)).when(turn % 5 == 1, F.concat(turn, F.lit(".1 Aims"))).when(turn % 5 == 2, "  ").otherwise(text)
    blocks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), (F.floor(turn / 2) + 1).cast("bigint").alias("page"), turn.alias("ord"), F.when(turn % 7 == 5, "equation").otherwise("text").alias("type"), said.alias("text"),
        ((turn % 4) * 200.0).alias("y"), (turn % 3 * 6 + 10.0).alias("height"), F.lit(800.0).alias("page_height"),
    )
    return blocks, blocks.groupBy("doc").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(f"WITH {_BLOCKS} SELECT * FROM c")
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of each page: chapters, numbered sections, and short tall text near the top."""
    return detect.heading_candidates(_blocks(spark, sf_dir)[0])


@query(
    rf"""WITH {_BLOCKS}, s AS (SELECT c.doc, title, page, row_number() OVER w AS n, lead(page) OVER w AS f, last_page FROM c JOIN p USING (doc) WINDOW w AS (PARTITION BY c.doc ORDER BY page, title)),
k AS (SELECT doc, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), format('heading-{{:02d}}', n)) AS id, title, page AS start_page, coalesce(greatest(page, f - 1), last_page) AS end_page, 'headings' AS strategy FROM s)
SELECT * FROM k UNION ALL SELECT doc, 'chapter-all', 'Document', first_page, last_page, 'single' FROM p WHERE doc NOT IN (SELECT doc FROM k)"""
)
def heading_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by headings, or one chapter where there are none."""
    from quire.sources.project import chapters_or

    blocks, pages = _blocks(spark, sf_dir)
    found = detect.chapters_from_starts(detect.heading_candidates(blocks), pages, "heading")
    return chapters_or(("headings", found), ("single", detect.single_chapter(pages)))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'claude' WHEN event_id % 4 = 1 THEN 'gemini' ELSE 'codex' END AS backend FROM events")
def backend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which backend a model's name asks for."""
    names = F.element_at(F.array(*map(F.lit, ("Claude-x", "gemini-2", "gpt-9", "my-claude"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", detect.backend_of(names).alias("backend"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000 + 0.5) DESC, o_orderkey) AS ord FROM orders")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (orders) of a page (customer) from the top down, from the left within a band."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("top"))
    return detect.reading_order(rows, ["o_custkey"], "top", "o_orderkey").select("o_orderkey", "ord")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS dx, CAST(l_linenumber % 3 AS DOUBLE) * 15 AS dy FROM lineitem)
SELECT l_orderkey, l_linenumber, sqrt(dx * dx + dy * dy) AS length, abs(dy) < 1 AS horizontal, abs(dx) < 1 AS vertical, 2 * dx + dy + 5 AS x, dy - 1 AS y, abs(dx) > 10 AND abs(dy) > 10 AS boxed FROM r WHERE sqrt(dx * dx + dy * dy) > 20"""
)
def segment_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long segments with their orientation, their end under a transform, and whether they span a rectangle."""
    dx, dy = F.col("l_quantity").cast("double") - 25, (F.col("l_linenumber") % 3).cast("double") * 15
    shift, shear = F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, -1.0))), F.array(*map(F.lit, (2.0, 0.0, 1.0, 1.0, 6.0, 0.0)))
    end = detect.applied(detect.composed(shift, shear), dx, dy)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", detect.long_segments(dx, dy).alias("s"), end.alias("e"), detect.rectangle(F.lit(0.0), F.lit(0.0), dx, dy).alias("r"))
    return rows.where("s IS NOT NULL").select("l_orderkey", "l_linenumber", "s.*", "e.x", "e.y", F.col("r").isNotNull().alias("boxed"))


@query(rf"SELECT l_orderkey, l_linenumber, regexp_matches(upper(regexp_replace({_FONT}, '^[^+]*\+', '')), '^({'|'.join(detect.MATH_FONTS)})|MATH') AS math FROM lineitem")
def math_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", detect.is_math_font(_font()).alias("math"))


_CONTENT = "coalesce(text, '') || [' \\begin{itemize}', ' \\bm{x}', ' \\begin{align*}', ' none', ' \\mathbb{R} \\cancel{x}'][CAST(turn % 5 + 1 AS INT)]"
_HEAD = "['\\usepackage{bm}', '\\usepackage{amssymb,amsmath}', ''][CAST(turn % 3 + 1 AS INT)]"
_RULES = ", ".join(f"{{'s': '{s}', 'n': '{n}'}}" for s, n in preamble.PACKAGE_RULES)


@query(
    f"""WITH r AS (SELECT conv_id, turn, {_CONTENT} AS c, {_HEAD} AS p FROM conversations)
SELECT conv_id, turn, list_transform(list_filter([{_RULES}], lambda x: contains(c, x.s) AND NOT contains(p, '\\usepackage{{' || x.n || '}}') AND NOT contains(p, '\\usepackage[' || x.n || ']') AND NOT contains(p, ',' || x.n || '}}') AND NOT contains(p, ',' || x.n || ',') AND NOT contains(p, '{{' || x.n || ',')), lambda x: x.n) AS packages FROM r"""
)
def auto_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that a page asks for and its preamble lacks."""
    signs = F.element_at(F.array(*map(F.lit, (" \\begin{itemize}", " \\bm{x}", " \\begin{align*}", " none", " \\mathbb{R} \\cancel{x}"))), (F.col("turn") % 5 + 1).cast("int"))
    heads = F.element_at(F.array(*map(F.lit, ("\\usepackage{bm}", "\\usepackage{amssymb,amsmath}", ""))), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", preamble.wanted_packages(F.concat(F.coalesce("text", F.lit("")), signs), heads).alias("packages"))


@query(
    r"""WITH d AS (SELECT s_suppkey AS doc, s_suppkey % 4 AS k FROM supplier) SELECT doc, CASE WHEN k = 0 THEN 'head.tex' ELSE 'second.tex' END AS path FROM d WHERE k != 3"""
)
def external_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""The \input among a source's first lines whose file holds a class."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"))
    texts = ("\\input{head}\n\\input{second}", "% \\input{head}\n\\input{plain}\n\\input{second.tex}", "\\input{missing}\n\\input{second}", "\n" * 25 + "\\input{head}")
    source = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc") % 4 + 1).cast("int"))
    files = docs.select("doc", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("source")) for p, t in (("head.tex", "\\documentclass{x}"), ("second.tex", "a\n\\documentclass{y}"), ("plain.tex", "no class"))])).alias("f")).select("doc", "f.*")
    return preamble.external_preamble(docs.withColumn("source", source), files)


def _one_line(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), key.alias("source"))


@query(
    r"""WITH p AS (SELECT p_partkey AS doc, p_partkey % 5 AS k, '\documentclass[' || ['letterpaper', '10pt,letterpaper', 'a4paper,12pt', '11pt', 'legalpaper'][CAST(p_partkey % 5 + 1 AS INT)] || ']{' || CASE WHEN p_partkey % 2 = 0 THEN 'article' ELSE 'report' END || '} % ' || p_name AS s FROM part),
a AS (SELECT doc, regexp_replace(s, '\{article\}', '{book}') AS s FROM p), b AS (SELECT doc, CASE WHEN contains(s, 'a4paper') THEN s ELSE regexp_replace(s, 'letterpaper|legalpaper|b5paper', 'a4paper', 'g') END AS s FROM a)
SELECT doc, CASE WHEN regexp_matches(s, '\[[^\]]*11pt[^\]]*\]') THEN s WHEN regexp_matches(s, '1[02]pt') THEN regexp_replace(s, '1[02]pt', '11pt') ELSE replace(s, '[', '[11pt,') END AS source FROM b"""
)
def class_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, paper and size of one-line preambles."""
    options = F.element_at(F.array(*map(F.lit, ("letterpaper", "10pt,letterpaper", "a4paper,12pt", "11pt", "legalpaper"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "article").otherwise("report")
    rows = _one_line(spark, sf_dir, F.concat(F.lit("\\documentclass["), options, F.lit("]{"), kind, F.lit("} % "), "p_name"))
    return udfs.passed(rows, lambda s: passes.font_size(passes.paper_size(passes.book_class(s, True), "a4paper"), 11.0))


@query(
    r"""WITH p AS (SELECT p_partkey AS doc, ['\documentclass{book}', '\documentclass{book}' || chr(10) || '\usepackage[T1]{fontenc}', '\documentclass{book}' || chr(10) || '\usepackage{lmodern}', 'no class', '\documentclass{book}' || chr(10) || '\usepackage{newtxtext,newtxmath}'][CAST(p_partkey % 5 + 1 AS INT)] AS s FROM part),
e AS (SELECT doc, CASE WHEN contains(s, '[T1]') THEN s ELSE replace(s, '\documentclass{book}', '\documentclass{book}' || chr(10) || '\usepackage[T1]{fontenc}') END AS s FROM p),
l AS (SELECT doc, replace(s, chr(10) || '\usepackage{lmodern}', '') AS s FROM e)
SELECT doc, CASE WHEN contains(s, 'newtxtext') THEN s WHEN contains(s, '[T1]') THEN replace(s, '\usepackage[T1]{fontenc}', '\usepackage[T1]{fontenc}' || chr(10) || '\usepackage{newtxtext,newtxmath}' || CASE WHEN ends_with(s, '{fontenc}') AND doc % 5 = 9 THEN chr(10) ELSE '' END) ELSE s || chr(10) || '\usepackage{newtxtext,newtxmath}' END AS source FROM l"""
)
def font_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and font package of a Times document."""
    texts = ("\\documentclass{book}", "\\documentclass{book}\n\\usepackage[T1]{fontenc}", "\\documentclass{book}\n\\usepackage{lmodern}", "no class", "\\documentclass{book}\n\\usepackage{newtxtext,newtxmath}")
    rows = _one_line(spark, sf_dir, F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 5 + 1).cast("int")))
    return udfs.passed(rows, lambda s: preamble.font_package(s, "times"))


@query(
    r"""WITH p AS (SELECT p_partkey AS doc, p_partkey % 7 + 5 AS n, p_name FROM part)
SELECT doc, p_name || chr(10) || CASE WHEN n BETWEEN 7 AND 12 THEN repeat('w', CAST(n AS INT)) || ' and on' ELSE repeat('w', CAST(n AS INT)) || '\\' || chr(10) || 'and on' END || chr(10) || '\chapter{' || p_name || '}' AS source FROM p"""
)
def line_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks where the page is ten characters wide, and chapters set by hand."""
    long_ = F.repeat(F.lit("w"), (F.col("p_partkey") % 7 + 5).cast("int"))
    text = F.concat("p_name", F.lit("\n"), long_, F.lit("\\\\\nand on\n\\noindent{\\Large\\textbf{Chapter 3}}\n\\bigskip\n{\\LARGE\\bfseries "), "p_name", F.lit("}\n\\vspace{1cm}"))
    return udfs.passed(_one_line(spark, sf_dir, text), lambda s: preamble.manual_chapters(preamble.line_breaks(s, 10.0)[0]))


@query(
    r"""SELECT p_partkey AS doc, '\begin{titlepage}' || chr(10) || '{' || CASE WHEN p_partkey % 3 = 0 THEN '\Large' WHEN p_partkey % 3 = 1 THEN '\Huge' ELSE '\fontsize{40}{48}\selectfont' END || ' ' || p_name || '}' || chr(10) || '\end{titlepage}' AS source FROM part"""
)
def title_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size commands of title pages that should be 14, 25 and 40 points."""
    rows = _one_line(spark, sf_dir, F.concat(F.lit("\\begin{titlepage}\n{\\Large "), "p_name", F.lit("}\n\\end{titlepage}")))
    sized = rows.withColumn("source", F.concat(F.col("doc") % 3, F.lit("|"), "source"))

    def step(s: str) -> str:
        k, _, text = s.partition("|")
        name = text.split("\n")[1][len("{\\Large ") : -1]
        return preamble.title_sizes(text, [(name, (14.0, 25.0, 40.0)[int(k)])])

    return udfs.passed(sized, step)


@query("SELECT doc_id, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS BOOLEAN) AS subset FROM (SELECT doc_id, list_distinct(string_split(lang || ' ' || coalesce(source, ''), ' ')) AS a, CASE WHEN doc_id % 2 = 0 THEN [lang, coalesce(source, ''), 'x'] ELSE [lang] END AS b FROM documents WHERE lang IS NOT NULL)")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one set of a row lies within the other."""
    a = F.array_distinct(F.split(F.concat("lang", F.lit(" "), F.coalesce("source", F.lit(""))), " "))
    b = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.coalesce("source", F.lit("")), F.lit("x"))).otherwise(F.array("lang"))
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", (F.size(F.array_except(a, b)) == 0).alias("subset"))
