"""Query op4_decontamination and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.winnowing import decontaminate
from quire.session import table


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 8) AS m FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bi AS (SELECT item_id, m, ws, unnest(range(1, CAST(len(ws) - m + 2 AS BIGINT))) AS i FROM b),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM bi),
ms AS (SELECT DISTINCT m FROM bw),
di AS (SELECT k, ws, m, unnest(range(1, CAST(greatest(len(ws) - m + 2, 1) AS BIGINT))) AS i FROM d, ms),
dw AS (SELECT k, i, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM di),
hits AS (SELECT k, i, dw.m, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.m = bw.m),
p AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT k, i, m FROM hits)) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT k, item_id FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p ON d.k = p.k LEFT JOIN it ON d.k = it.k
"""
