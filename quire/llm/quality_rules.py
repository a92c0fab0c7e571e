"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measured
values and one bit for each rule that failed; a *policy* is a named version of a
mask over these bits. Changing the policy, or asking what each of its rules
costs, reads the ledger only: a document is rejected by a policy when
``fail_bits & mask`` is not zero, and ablations come from counts grouped by that
expression, of which there are at most ``2 ** number of rules``.

Defined cases: a null or empty text has no words and every measure 0 (so
``too_short`` fails); repeated rows each get their own row; ids may be null or
repeat; other columns are ignored, whatever their names; an empty table gives an
empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import WordHash, blank_words, chunks, flatten, grams, mix, starts, texts_of

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes([9, 10, 11, 12, 13, 32]) + bytes(range(0x80, 0xC0))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measures holds."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule; a changed rule gets a new bit.
RULES = (
    Rule(0, "too_short", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule(3, "shouting", "ascii_letters >= 40 AND 2 * n_upper > ascii_letters"),
    Rule(4, "exclaiming", "n_words >= 20 AND 10 * n_exclaims > 3 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule(7, "stuttering", "10 * n_stutters > 3 * n_words"),
)
BASE = ("too_short", "repeated_windows")

#: Versioned policies: the rules that reject. Versions are only ever added.
POLICIES = {
    "base-1": BASE,
    "web-1": (*BASE, "symbol_heavy", "shouting", "exclaiming"),
    "web-2": (*BASE, "symbol_heavy", "shouting", "exclaiming", "long_words", "repeated_lines", "stuttering"),
}
PRODUCTION = "web-2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "ascii_letters", "n_upper", "n_exclaims", "n_stutters")


def mask(policy: str) -> int:
    """The policy's bits."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(offsets: np.ndarray, h: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each text: words inside a k-word window that the text has twice or more."""
    n = len(offsets) - 1
    at, owner = starts(offsets, k)
    if not len(at):
        return np.zeros(n, np.int64)
    key = grams(h, k)[at] ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(h) + 1, np.int64)
    np.add.at(delta, at[twice], 1)
    np.add.at(delta, at[twice] + k, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
    return inside[offsets[1:]] - inside[offsets[:-1]]


def _stutters(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each text: words equal to the word before them."""
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        at, _ = starts(offsets, 2)
        same[at + 1] = h[at] == h[at + 1]
    before = np.concatenate([[0], np.cumsum(same)])
    return before[offsets[1:]] - before[offsets[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in chunks(batches, "text"):
        texts = texts_of(batch, "text")
        words = [blank_words(t) for t in texts]
        h, offsets = flatten(words, hashes)
        lines = np.array([_line_counts(t) for t in texts], np.int64).reshape(-1, 2)
        kept = lambda t, drop: len(t) - len(t.translate(None, drop))
        values = {
            "n_words": np.diff(offsets),
            "word_chars": [len(t.translate(None, _NOT_COUNTED)) for t in texts],
            "n_symbols": [kept(t, SYMBOLS) for t in texts],
            "n_lines": lines[:, 0],
            "n_dup_lines": lines[:, 1],
            "n_repeat_words": repeated_words(offsets, h),
            "ascii_letters": [kept(t, _LETTERS) for t in texts],
            "n_upper": [kept(t, _UPPER) for t in texts],
            "n_exclaims": [kept(t, b"!") for t in texts],
            "n_stutters": _stutters(offsets, h),
        }
        out = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*out, *(pa.array(values[m], pa.int64()) for m in MEASURES)], [*names, *MEASURES])


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every measure of every document; one pass, no shuffle."""
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    types = ", ".join([f"k{i} {t}" for i, (_, t) in enumerate(slim.dtypes[:-1])] + [f"{m} bigint" for m in MEASURES])
    out = slim.mapInArrow(_measure, types)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MEASURES)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``measure`` plus ``fail_bits``: bit i is set where rule i failed."""
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return measure(docs, text, keep).withColumn("fail_bits", F.expr(f"CAST({bits} AS BIGINT)"))


def apply_policy(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """``kept``: the document fails no rule of the policy."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone (they
    would come back without it), and how many the policy keeps with and without it.

    The ledger is first counted by its masked bits, so that what follows sees at
    most 2 ** len(RULES) rows.
    """
    m = mask(policy)
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit"))
    return (
        counts.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when((hit != 0) & (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept_with"),
            F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("kept_without"),
        )
        .withColumn("policy", F.lit(policy))
    )
