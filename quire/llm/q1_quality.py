"""Query op1_quality_rules and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.quality_rules import PRODUCTION, RULES, apply_policy, ledger, mask
from quire.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")), PRODUCTION)
    base = mask("base-1")
    return entries.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"(fail_bits & {base}) != 0 AS base_failed", "kept", "fail_bits",
    )


_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT k, ws, unnest(range(1, CAST(len(ws) AS BIGINT) + 1)) AS i FROM w),
grams AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS g FROM pos WHERE i + 7 <= len(ws)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n >= 2),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY k),
st AS (SELECT k, count(*) AS n_stutters FROM pos WHERE i > 1 AND ws[i] = ws[i - 1] GROUP BY k),
ln AS (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d),
li AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT w.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_stutters, 0) AS n_stutters,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS ascii_letters,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims
  FROM w LEFT JOIN li ON w.k = li.k LEFT JOIN rep ON w.k = rep.k LEFT JOIN st ON w.k = st.k),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {mask("base-1")}) != 0 AS base_failed, (fail_bits & {mask(PRODUCTION)}) = 0 AS kept, fail_bits
FROM b
"""
