"""Queries on texts: coverage, vocabularies, n-grams, headers, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import compare, sequence
from quire.operators.joins import rule_hits
from quire.plans.registry import query
from quire.session import table

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\s\x{0085}\p{Z}]+'), lambda w: regexp_matches(w, '[\p{L}\p{M}\p{N}]'))"


#: Pairs of passage and document that one task counts at most.
SLICE_PAIRS = 1 << 18


def _vocabulary(df: DataFrame, key: str) -> DataFrame:
    """(key, word): the distinct tokens of each text."""
    return df.select(key, F.explode(F.array_distinct(T.simple_tokens(F.col("text")))).alias("word"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, hits, item_size): shared distinct words of every passage and document that share one.

    The passages' words of a document lie in one of slices whose number follows the input, so pairs are
    counted and ranked there as they are, and only a slice's best go on.
    """
    passages, texts = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    items = _vocabulary(passages, "item_id")
    size = items.groupBy("item_id").agg(F.count("*").alias("item_size"))
    n_slices = max(1, -(-passages.count() * texts.count() // SLICE_PAIRS))
    docs = _vocabulary(texts, "doc_id").join(items.select("word").distinct(), "word", "left_semi").repartition(n_slices, "doc_id")
    return items.join(docs, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits")).join(size, "item_id")


_COVERAGE = rf"""
b AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS word FROM benchmark),
n AS (SELECT item_id, count(*) AS item_size FROM b GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS word FROM documents),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM b JOIN d USING (word) GROUP BY ALL)"""


@query(rf"""WITH {_COVERAGE},
c AS (SELECT item_id, doc_id, round(hits / item_size, 4) AS coverage FROM h JOIN n USING (item_id))
SELECT item_id, doc_id, coverage, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, doc_id) AS rank FROM c QUALIFY rank <= 3""")
def word_coverage_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage, the three documents that hold the largest share of its vocabulary."""
    c = _coverage(spark, sf_dir).select("item_id", "doc_id", F.round(F.col("hits") / F.col("item_size"), 4).alias("coverage"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("coverage"), "doc_id"))
    return c.withColumn("rank", rank.cast("bigint")).where("rank <= 3")


@query(rf"""WITH {_COVERAGE}, m AS (SELECT doc_id, count(*) AS size FROM d GROUP BY doc_id),
c AS (SELECT doc_id, item_id, round(hits / size, 4) AS coverage FROM h JOIN m USING (doc_id))
SELECT doc_id, max(coverage) AS coverage, arg_min(item_id, struct_pack(c := -coverage, i := item_id)) AS item_id FROM c GROUP BY doc_id""")
def reverse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the largest share of its vocabulary that one passage covers."""
    docs = _vocabulary(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("size"))
    c = _coverage(spark, sf_dir).join(docs, "doc_id").select("doc_id", "item_id", F.round(F.col("hits") / F.col("size"), 4).alias("coverage"))
    return c.groupBy("doc_id").agg(F.max("coverage").alias("coverage"), F.min_by("item_id", F.struct(-F.col("coverage"), "item_id")).alias("item_id"))


@query(r"""SELECT lang, count(*) AS n_docs, CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w != ''))) AS BIGINT) AS n_words,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and characters by language."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.size(words).cast("bigint")).alias("n_words"), F.sum(F.length(F.coalesce("text", F.lit(""))).cast("bigint")).alias("n_chars")
    )


@query(rf"""SELECT lang, count(DISTINCT word) AS vocabulary, count(*) AS entries FROM (SELECT lang, doc_id, unnest(list_distinct({_TOKENS})) AS word FROM documents) GROUP BY lang""")
def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact vocabulary of each language, and (document, word) entries."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("lang", F.explode(F.array_distinct(T.simple_tokens(F.col("text")))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("entries"))


@query(
    rf"""WITH w AS (SELECT doc_id, list_distinct({_TOKENS}) AS ws FROM documents),
s AS (SELECT doc_id, ws, list_filter(ws, lambda x: regexp_matches(x, '{T.MATH_TOKEN}') OR (length(x) = 1 AND NOT regexp_matches(x, '\p{{L}}'))) AS m FROM w)
SELECT doc_id, CAST(len(m) AS BIGINT) AS n_math, CAST(len(ws) - len(m) AS BIGINT) AS n_text FROM s"""
)
def math_text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens that are mathematical, and the others."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.simple_tokens(F.coalesce("text", F.lit("")))).alias("ws"))
    n_math = F.size(F.filter("ws", T.is_math)).cast("bigint")
    return words.select("doc_id", n_math.alias("n_math"), (F.size("ws") - n_math).cast("bigint").alias("n_text"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[\s\x{0085}\p{Z}]+', '', 'g') AS t FROM conversations),
i AS (SELECT conv_id, turn, t, unnest(range(1, greatest(length(t), 1))) AS i FROM t),
g AS (SELECT conv_id, turn, substring(t, CAST(i AS BIGINT), 2) AS g, count(*) AS n FROM i GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, CAST(sum(a.n) AS BIGINT) AS total, CAST(sum(least(a.n, coalesce(b.n, 0))) AS BIGINT) AS matched
  FROM g a LEFT JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.g = b.g GROUP BY ALL)
SELECT conv_id, turn, total, matched, matched / total AS coverage FROM p
WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = p.conv_id AND c.turn = p.turn + 1)"""
)
def bigram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset coverage of each turn's character bigrams by the next turn's; white space is ignored."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_spaces(F.coalesce("text", F.lit(""))).alias("t"))
    grams = turns.select("conv_id", "turn", F.explode(T.char_ngrams(F.col("t"))).alias("g")).groupBy("conv_id", "turn", "g").agg(F.count("*").alias("n"))
    following = grams.select("conv_id", (F.col("turn") - 1).alias("turn"), "g", F.col("n").alias("m"))
    both = grams.join(following, ["conv_id", "turn", "g"], "left").groupBy("conv_id", "turn")
    sums = both.agg(F.sum("n").alias("total"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("matched"))
    has_next = turns.select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    return sums.join(has_next, ["conv_id", "turn"], "left_semi").withColumn("coverage", F.col("matched") / F.col("total"))


@query()
def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked longest-common-subsequence similarity of neighbouring turns."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("a")).join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", compare.sequence_similarity(F.col("a"), F.col("b")).alias("similarity"))


_VOCAB_BY_LABEL = rf"""w AS (SELECT DISTINCT quality, word FROM (SELECT quality, unnest({_TOKENS}) AS word FROM documents JOIN labels USING (doc_id)) WHERE quality IS NOT NULL),
a AS (SELECT word FROM w WHERE quality = 1), b AS (SELECT word FROM w WHERE quality = 0)"""


def _by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, in_a, in_b): vocabulary of good and of bad documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = docs.select("quality", F.explode(F.array_distinct(T.simple_tokens(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.bool_or(F.col("quality") == 1).alias("in_a"), F.bool_or(F.col("quality") == 0).alias("in_b"))


@query(f"WITH {_VOCAB_BY_LABEL} SELECT word FROM a EXCEPT SELECT word FROM b")
def vocab_only_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_label(spark, sf_dir).where("in_a AND NOT in_b").select("word")


@query(f"WITH {_VOCAB_BY_LABEL} SELECT word FROM b EXCEPT SELECT word FROM a")
def vocab_only_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_label(spark, sf_dir).where("in_b AND NOT in_a").select("word")


@query(f"WITH {_VOCAB_BY_LABEL} SELECT word FROM a INTERSECT SELECT word FROM b")
def vocab_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_label(spark, sf_dir).where("in_a AND in_b").select("word")


@query(f"WITH {_VOCAB_BY_LABEL} SELECT length(word) AS word_length, count(*) AS n FROM (SELECT word FROM a UNION SELECT word FROM b) GROUP BY 1")
def vocab_union_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the words in the union of both vocabularies."""
    return _by_label(spark, sf_dir).where("in_a OR in_b").groupBy(F.length("word").cast("bigint").alias("word_length")).agg(F.count("*").alias("n"))


def _lines(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return df.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents)
SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM l WHERE line != '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3"""
)
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more."""
    lines = _lines(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.trim("line").alias("line")).where("line != ''")
    each = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("line").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).where("n_docs >= 3")


_HEADED = "'CHAPTER ' || (turn + 1) || '. ' || role || chr(10) || coalesce(text, '')"


@query(
    rf"""WITH l AS (SELECT conv_id, turn, unnest(string_split({_HEADED}, chr(10))) AS line, generate_subscripts(string_split({_HEADED}, chr(10)), 1) AS pos FROM conversations)
SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) AS body FROM l WHERE NOT regexp_matches(trim(line), '^CHAPTER\s+\d+\.\s+') GROUP BY ALL"""
)
def strip_running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are running chapter headers removed from the pages of a conversation."""
    headed = F.concat(F.lit("CHAPTER "), (F.col("turn") + 1).cast("string"), F.lit(". "), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")))
    kept = F.filter(F.split(headed, "\n", -1), lambda x: ~F.trim(x).rlike(r"^CHAPTER\s+\d+\.\s+"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(kept, "\n").alias("body"))


_PAGES = "string_agg('%% === Page ' || (turn + 1) || ' ===' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn)"


def accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n_pages, source): each conversation as a document with page markers."""
    page = F.concat(F.lit("%% === Page "), (F.col("turn") + 1).cast("string"), F.lit(" ===\n"), F.coalesce("text", F.lit("")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", page.alias("t")).alias("s"))
    grouped = turns.groupBy("conv_id").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list("s")).alias("pages"))
    return grouped.select("conv_id", "n_pages", F.array_join(F.transform("pages", lambda x: x["t"]), "\n").alias("source"))


@query(f"SELECT conv_id, count(*) AS n_pages, {_PAGES} AS source FROM conversations GROUP BY conv_id")
def accumulate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulated(spark, sf_dir)


@query(
    f"""SELECT conv_id, array_to_string(list_filter(string_split(s, chr(10)), lambda x: NOT regexp_matches(trim(x), '^%% === Page ([0-9]+) ===$')), chr(10)) AS body
FROM (SELECT conv_id, {_PAGES} AS s FROM conversations GROUP BY conv_id)"""
)
def strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulated(spark, sf_dir).select("conv_id", T.without_markers(F.col("source")).alias("body"))


@query(
    """WITH c AS (SELECT conv_id, turn, string_agg(coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM conversations)
SELECT conv_id, turn, length(t) AS context_chars, CASE WHEN length(t) > 700 THEN left(t, 200) || chr(10) || '[...]' || chr(10) || right(t, 400) ELSE t END AS context FROM c"""
)
def cumulative_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages so far, cut to head and tail where they are long."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = table(spark, sf_dir, "conversations")
    so_far = turns.select("conv_id", "turn", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n").alias("t"))
    return so_far.select("conv_id", "turn", F.length("t").cast("bigint").alias("context_chars"), T.truncated(F.col("t"), 200, 400, 100).alias("context"))


_PAGED = """l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, pos // 3 AS page, pos, trim(line) AS line FROM l WHERE trim(line) != '' AND NOT starts_with(trim(line), '%%')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS e FROM p),
g AS (SELECT doc_id, page, list(line ORDER BY pos) FILTER (h <= 5) AS head, list(line ORDER BY pos) FILTER (e <= 5) AS tail FROM r GROUP BY ALL)"""


@query(
    f"""WITH {_PAGED}, k AS (SELECT a.doc_id, a.page, (SELECT max(i) FROM range(1, 6) t(i) WHERE i <= len(a.tail) AND i <= len(b.head) AND a.tail[len(a.tail) - i + 1:len(a.tail)] = b.head[1:i]) AS overlap
  FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.page = a.page + 1)
SELECT doc_id, page, CAST(overlap AS BIGINT) AS overlap FROM k WHERE overlap IS NOT NULL"""
)
def boundary_overlap_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated across the boundary of neighbouring pages (three lines each), at most five."""
    lines = _lines(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("page", F.floor(F.col("pos") / 3))
    return sequence.boundary_overlaps(lines, "doc_id", "page", "pos", "line").withColumn("overlap", F.col("overlap").cast("bigint"))


@query(
    f"""WITH {_PAGED} SELECT a.doc_id, a.page, a.tail[len(a.tail)] AS line FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.page = a.page + 1 WHERE a.tail[len(a.tail)] = b.head[1]"""
)
def page_boundary_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of a page that the next page starts with."""
    lines = _lines(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("page", F.floor(F.col("pos") / 3)).withColumn("line", F.trim("line"))
    lines = lines.where("line != '' AND NOT startswith(line, '%%')")
    ends = lines.groupBy("doc_id", "page").agg(F.min_by("line", "pos").alias("head"), F.max_by("line", "pos").alias("tail"))
    after = ends.select("doc_id", (F.col("page") - 1).alias("page"), F.col("head").alias("next_head"))
    return ends.join(after, ["doc_id", "page"]).where("tail = next_head").select("doc_id", "page", F.col("tail").alias("line"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, line FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l) WHERE line = n"""
)
def consecutive_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines equal to the line after them."""
    lines = _lines(table(spark, sf_dir, "documents"), ["doc_id"])
    following = F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("n", following).where("line = n").select("doc_id", "pos", "line")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, with the number of its copies."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("text_md5"))
    return docs.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


RULES = [("article", "the "), ("conjunction", "and "), ("dollar", "$"), ("accent", "é"), ("pipe", "|"), ("benchmark", "Benchmark")]


@query(f"SELECT doc_id, rule FROM documents, (VALUES {', '.join(f'({n!r}, {p!r})' for n, p in RULES)}) r(rule, pattern) WHERE contains(text, pattern)")
def rule_table_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the rules whose pattern they contain."""
    return rule_hits(table(spark, sf_dir, "documents"), "text", RULES).select("doc_id", "rule")


@query(r"""SELECT doc_id, replace(regexp_replace('costs ' || chr(36) || n_chars || ' and ' || chr(92) || chr(36) || '5', '([^\\])\$(\d)', '\1\\$\2', 'g'), chr(0), '') AS escaped FROM documents""")
def currency_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dollar before a digit escaped, one that already is left alone."""
    line = F.concat(F.lit("costs $"), F.col("n_chars").cast("string"), F.lit(" and \\$5"))
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_currency(line).alias("escaped"))


@query(
    r"""SELECT conv_id, turn, replace(replace(replace(coalesce(text, ''), 'th', 'θ'), 'or', '∨'), chr(10), chr(10) || chr(10)) AS body FROM conversations"""
)
def symbol_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered chain of replacements."""
    body = T.replaced(F.coalesce("text", F.lit("")), (("th", "θ"), ("or", "∨"), ("\n", "\n\n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))


@query(r"""SELECT doc_id, md5(regexp_replace(replace(coalesce(text, ''), chr(10), repeat(chr(10), 5)), '\n{4,}', repeat(chr(10), 3), 'g')) AS body_md5 FROM documents""")
def collapse_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n" * 5))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_blank_lines(spread)).alias("body_md5"))


@query()
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each conversation: its user turns as the original, its assistant turns as the reproduction."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return compare.report(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", "turn")
