"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation's rows are put in order of their turn; each turn's parts are
visited in order: text is escaped and appended; an image, audio or document part
becomes the placeholder ``<|kind|>`` and is recorded as an attachment (turn, kind,
reference, tokens). A turn is written as

    <|im_start|>role NEWLINE content <|im_end|> NEWLINE

Every mark starts with ``<|``. Inside texts and roles ``&``, ``<`` and ``[`` are
written as ``&amp;``, ``&lt;`` and ``&#91;`` (and a newline in a role as
``&#10;``), so that no text can spell a mark of this template or of the common
bracketed ones, and replacing them back in the reverse order restores the text.
Reading parts a turn's content at its placeholders before it restores the texts, so a
text that spells ``<|image|>`` stays a text. The k-th placeholder of a conversation
belongs to its k-th attachment; text parts that touch read back as one.

Defined cases: null role, text, kind or reference count as empty; an unknown kind
of part is handled like a document; null turns come last; equal turns are ordered
by role, then text, then their other parts; a null conv_id is a conversation of
its own; repeated rows are turns of their own; a conversation is one row of output, so
its turns meet in one task, however long it is; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What is replaced inside texts, in this order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))
#: Tokens that a part expands to where it does not say itself: an image's patches, a second of audio, a page.
DEFAULT_TOKENS = {"image": 576, "audio": 50, "document": 800}
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(c: Column, table=ESCAPES) -> Column:
    for raw, safe in table:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, table=ESCAPES) -> Column:
    for raw, safe in reversed(table):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin(*DEFAULT_TOKENS), p["kind"]).otherwise(F.lit("document"))


def _tokens(p: Column) -> Column:
    default = F.lit(DEFAULT_TOKENS["document"])
    for kind in ("image", "audio"):
        default = F.when(_kind(p) == kind, F.lit(DEFAULT_TOKENS[kind])).otherwise(default)
    return F.coalesce(p["tokens"], default.cast("bigint"))


def _visit(p: Column) -> Column:
    """A part in the formatted text."""
    placeholder = F.concat(F.lit("<|"), _kind(p), F.lit("|>"))
    return F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder)


def text_parts(text: Column) -> Column:
    """A plain text as a one-part content."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("tokens")))


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None) -> DataFrame:
    """(conv_id, formatted, attachments, n_attachment_tokens), a row for each conversation.

    ``parts``: a column of ``array<PART>``; by default the column ``text`` as one part.
    """
    parts = text_parts(F.col("text")) if parts is None else parts
    parts = F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    one = F.struct(
        F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), parts.alias("parts")
    )
    turns = rows.select(F.col(conv).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def write(t: Column) -> Column:
        content = F.array_join(F.transform(t["parts"], _visit), "")
        return F.concat(F.lit(START), escape(t["role"], ROLE_ESCAPES), F.lit("\n"), content, F.lit(END))

    def attached(t: Column, i: Column) -> Column:
        found = F.filter(t["parts"], lambda p: ~_is_text(p))
        return F.transform(
            found, lambda p: F.struct(i.alias("turn_index"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))
        )

    attachments = F.flatten(F.transform("turns", attached))
    total = F.aggregate(F.col("attachments"), F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])
    out = turns.select("conv_id", F.array_join(F.transform("turns", write), "").alias("formatted"), attachments.alias("attachments"))
    return out.withColumn("n_attachment_tokens", total)


def read_parts(content: Column) -> Column:
    """A turn's content as ``array<struct<kind, text>>``: texts restored, other parts with a null text."""
    kinds = "|".join(DEFAULT_TOKENS)
    pieces = F.filter(F.split(content, rf"(?=<\|(?:{kinds})\|>)|(?<=<\|(?:{kinds})\|>)"), lambda x: x != "")

    def part(piece: Column) -> Column:
        mark = piece.startswith("<|")
        kind = F.when(mark, F.regexp_extract(piece, r"<\|(\w+)\|>", 1)).otherwise(F.lit("text"))
        return F.struct(kind.alias("kind"), F.when(~mark, unescape(piece)).alias("text"))

    return F.transform(pieces, part)


def read_chat(formatted: Column) -> Column:
    """The turns that a formatted text holds: ``array<struct<role, parts, text, trained>>``.

    ``text`` joins the text parts. ``trained`` marks the loss mask: the texts of assistant
    turns, and nothing of the marks and placeholders around them.
    """
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def parse(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        role = unescape(F.substring_index(body, "\n", 1), ROLE_ESCAPES)
        parts = read_parts(F.substr(body, F.instr(body, "\n") + F.lit(1)))
        text = F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["text"]), "")
        return F.struct(role.alias("role"), parts.alias("parts"), text.alias("text"), (role == "assistant").alias("trained"))

    return F.transform(pieces, parse)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    from quire.session import table

    own = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    turns = format_chat(rows).withColumn("turns", read_chat(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), "")
    return turns.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *,
  length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
    + 4 * (length(text) - length(replace(text, '[', ''))) + length(role) + 12 + 1 + 10 + 1 AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
