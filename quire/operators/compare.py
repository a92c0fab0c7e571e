"""Comparison of an original and its reproduction: coverage, similarity, report rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.functions import text as T

CHUNK = 200
MAX_WORDS = 50_000
WEAK = 0.60


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence.

    Row by row over bit vectors: bit j of the state is 0 where the row gains a
    match at b[j], so a row costs a few operations on one big number.
    """
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    state = full
    for w in a:
        hit = state & places.get(w, 0)
        state = (state + hit | state - hit) & full
    return len(b) - state.bit_count()


def chunked_similarity(a: list[str], b: list[str], max_words: int = MAX_WORDS, chunk: int = CHUNK) -> float:
    """2 * matches / words over aligned chunks; 1 where both are empty, 0 where one is."""
    if not a or not b:
        return float(not a and not b)
    a, b = (x[:: len(x) // max_words] if len(x) > max_words else x for x in (a, b))
    n = max(1, min(len(a), len(b)) // chunk)
    matches = words = 0
    for i in range(n):
        x, y = (s[i * len(s) // n : i * len(s) // n + chunk] for s in (a, b))
        matches += lcs_length(x, y)
        words += len(x) + len(y)
    return 2 * matches / words if words else 0.0


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([chunked_similarity(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=np.float64)


def sequence_similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts as word sequences; the words are split by Spark, the subsequence is Arrow-batched."""
    return _similarity(T.tokens(F.coalesce(a, F.lit(""))), T.tokens(F.coalesce(b, F.lit(""))))


def report(original: DataFrame, reproduced: DataFrame, doc: str, page: str) -> DataFrame:
    """One row for each document of the original: totals, coverage both ways, missing and extra
    words, bigram coverage, similarity, and whether it needs a closer look."""

    def gathered(df: DataFrame, side: str) -> DataFrame:
        pages = F.array_sort(F.collect_list(F.struct(page, "text")))
        joined = F.array_join(F.transform(pages, lambda p: p["text"]), "\n")
        return df.groupBy(doc).agg(F.count("*").alias(f"pages_{side}"), joined.alias(f"text_{side}"))

    both = gathered(original, "a").join(gathered(reproduced, "b"), doc, "left")
    both = both.withColumn("pages_b", F.coalesce("pages_b", F.lit(0))).withColumn("text_b", F.coalesce("text_b", F.lit("")))
    both = both.withColumn("wa", T.tokens(F.col("text_a"))).withColumn("wb", T.tokens(F.col("text_b")))
    both = both.repartition(doc)  # the joins below want it so, and tokens are made once instead of in every expression
    math = lambda c: F.filter(F.array_distinct(c), T.is_math)
    words = lambda c: F.filter(F.array_distinct(c), lambda w: ~T.is_math(w))
    grams = both.select(doc, F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("text_a").alias("t")), F.struct(F.lit("b").alias("s"), F.col("text_b").alias("t")))).alias("x"))
    grams = grams.select(doc, "x.s", F.explode(T.char_ngrams(T.without_spaces(F.col("x.t")))).alias("g")).groupBy(doc, "g").agg(
        F.count_if(F.col("s") == "a").alias("na"), F.count_if(F.col("s") == "b").alias("nb")
    )
    sums = grams.groupBy(doc).agg(F.sum("na").alias("total"), F.sum(F.least("na", "nb")).alias("matched"))
    out = both.join(sums, doc, "left")
    similarity = F.round(_similarity("wa", "wb"), 4)
    missing = F.array_except("wa", "wb")
    return out.select(
        doc, "pages_a", "pages_b", F.size("wa").alias("words_a"), F.size("wb").alias("words_b"),
        F.round(F.try_divide(F.size("wb"), F.size("wa")), 4).alias("word_ratio"),
        F.round(T.set_coverage(F.col("wa"), F.col("wb")), 4).alias("coverage"),
        F.round(T.set_coverage(F.col("wb"), F.col("wa")), 4).alias("reverse_coverage"),
        F.round(T.set_coverage(math(F.col("wa")), math(F.col("wb"))), 4).alias("math_coverage"),
        F.round(T.set_coverage(words(F.col("wa")), words(F.col("wb"))), 4).alias("text_coverage"),
        F.round(F.try_divide("matched", "total"), 4).alias("bigram_coverage"),
        similarity.alias("similarity"),
        F.size(missing).alias("n_missing"),
        F.slice(F.array_sort(missing), 1, 10).alias("missing_samples"),
        (similarity < WEAK).alias("weak"),
    )
