"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text are counted over its distinct words: the word itself and its
prefixes of 4 to 6 letters (insults are inflected, and a stem carries what its
many forms each show too rarely). One weight vector is shared by all thresholds:

    P(severity > k) = sigmoid(w . x - t_k),   t_0 < t_1 < t_2

so that a text gets one linear score and, from it, a probability for each grade
and an expected severity. The score of a text is the sum over its distinct words
of the word's own score, which makes scoring one pass without a shuffle.

Labels say only toxic or not. The grades of toxic training texts are set by how
many of their distinct words carry a feature that is tied to the toxic label in
the same sample: 1 (few), 2, 3 (many), cut at ``GRADE_CUTS``.

The model is fitted on a bounded sample of labelled rows: at most ``max_rows`` ids of
each label, by the hash of the id. Copies of one text would make its own words
look toxic or clean, so texts with the same smallest word hashes share one vote.
Features are counted and screened by a grouped aggregation, by the z-score of their two
shares of these votes (``MIN_Z``); a feature needs ``MIN_VOTES`` votes of toxic texts, so
the sample bounds the weights, which are broadcast. Only the screened features of each
sampled text reach the driver. Weights are kept at or above 0 and shrunk by ``L1``: no
amount of clean text excuses an insult.

Defined cases: null or empty texts have no features and get the score of a text
without any; labels that match no text, null labels and repeated label rows (the
largest label wins) are allowed; without toxic labels every text is grade 0; repeated
documents are scored each and share one vote; of equally probable grades the lower is
taken; very long texts are one row of a batch; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import WordHash, chunks
from quire.session import written

GRADES = 4
GRADE_CUTS = (3, 6)
PREFIXES = (4, 5, 6)
MAX_ROWS = 4000
MIN_Z = 5.0
MIN_VOTES = 3.0
SKETCH = 4
L1 = 2e-5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The word marked by a final $, and its proper prefixes."""
    return [word + "$", *(word[:k] for k in PREFIXES if k < len(word))]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (20.0, 21.0, 22.0)
    rows: int = 0

    def word_score(self, word: str) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features_of(word))

    def above(self, score: float) -> list[float]:
        """P(severity > k) for k = 0, 1, 2."""
        return [_sigmoid(score - t) for t in self.thresholds]


def _sigmoid(x):
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x))))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text") -> DataFrame:
    """(doc_id, toxic, n, vote, words) for at most ``max_rows`` ids of each label.

    ``n`` is how many labelled rows there are of that label. The ids of the sample
    are at most 2 * max_rows, so they can be broadcast to the texts.
    """
    each = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    each = each.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in each.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [
        each.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("n", F.lit(totals.get(value, 0)).cast("bigint"))
        for value in (0, 1)
    ]
    ids = parts[0].unionByName(parts[1])
    slim = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    found = written(slim.mapInArrow(_distinct_words, "doc_id bigint, toxic int, n bigint, sketch binary, words array<string>"), "toxicity-sample")
    votes = found.groupBy("toxic", "sketch").agg((1 / F.count("*")).alias("vote"))
    return found.join(votes, ["toxic", "sketch"]).select("doc_id", "toxic", "n", "vote", "words")


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in chunks(batches, "text"):
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        words = [sorted(words_of(t)) for t in get("text").to_pylist()]
        # Texts without words are told apart by their id.
        sketch = [repr(heapq.nsmallest(SKETCH, map(hashes.__getitem__, w)) or d).encode() for w, d in zip(words, get("doc_id").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [get("doc_id"), get("toxic"), get("n"), pa.array(sketch, pa.binary()), pa.array(words, pa.list_(pa.string()))],
            ["doc_id", "toxic", "n", "sketch", "words"],
        )


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, vote, feature) for each distinct feature of each text."""
    for batch in batches:
        for toxic, vote, words in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("toxic", "vote", "words")), strict=True):
            found = sorted({f for w in words for f in features_of(w)})
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * n, pa.int32()), pa.array([vote] * n, pa.float64()), pa.array(found, pa.string())], ["toxic", "vote", "feature"])


def screened(rows: DataFrame, n1: float, n0: float) -> list[str]:
    """Features tied to the toxic label, in order of their names; ``n1``, ``n0``: votes of toxic and clean texts."""
    each = rows.select("toxic", "vote", "words").mapInArrow(_text_features, "toxic int, vote double, feature string")
    share = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("vote")).otherwise(0.0))
    counted = each.groupBy("feature").agg(share(1).alias("a"), share(0).alias("b")).where(F.col("a") >= MIN_VOTES - 1e-9)
    clean = max(n0, 1.0)
    p = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (F.col("a") / n1 - F.col("b") / clean) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / clean))
    return sorted(r.feature for r in counted.where(z >= MIN_Z).select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text") -> Model:
    """Fit on the bounded sample."""
    rows = sample(docs, labels, max_rows, text)
    sums = {r.toxic: r for r in rows.groupBy("toxic").agg(F.sum("vote").alias("votes"), F.count("*").alias("rows")).collect()}
    n = sum(r.rows for r in sums.values())
    if 1 not in sums:
        return Model(rows=n)
    n1, n0 = sums[1].votes, sums[0].votes if 0 in sums else 0.0
    names = screened(rows, n1, n0)
    if not names:
        return Model(rows=n)
    index = {f: i for i, f in enumerate(names)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's screened features, once for each word that has them, and how many words have one."""
        for batch in batches:
            found = [[[index[f] for f in features_of(w) if f in index] for w in words] for words in batch.column(batch.schema.get_field_index("words")).to_pylist()]
            flat, tied = [[i for x in t for i in x] for t in found], [sum(map(bool, t)) for t in found]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "toxic", "n", "vote")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(flat, pa.list_(pa.int32())), pa.array(tied, pa.int32())], ["doc_id", "toxic", "n", "vote", "features", "tied"])

    kinds = "doc_id bigint, toxic int, n bigint, vote double, features array<int>, tied int"
    got = rows.mapInArrow(hits, kinds).toArrow().sort_by([("doc_id", "ascending"), ("tied", "ascending")]).combine_chunks()
    toxic, tied, vote = (got[c].to_numpy() for c in ("toxic", "tied", "vote"))
    lists = got["features"].combine_chunks()
    row, col = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
    grade = np.where(toxic > 0, 1 + np.searchsorted(GRADE_CUTS, tied, side="right"), 0)
    stands = vote * got["n"].to_numpy() / np.where(toxic > 0, n1, max(n0, 1.0))  # rows of the label that each stands for
    w, t = _descend(row, col, grade, stands / stands.sum(), len(names))
    return Model({f: float(w[i]) for f, i in index.items() if w[i] != 0}, tuple(map(float, t)), n)


def _descend(row, col, grade, weight, n_features, rounds: int = 800):
    """Adam with a proximal step on the ordinal log-likelihood. Thresholds stay ordered: t_0, then steps exp(s_k)."""
    n = len(grade)
    w, t0, steps = np.zeros(n_features), 1.0, np.zeros(GRADES - 2)
    m = np.zeros(n_features + GRADES - 1)
    v = np.zeros_like(m)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for i in range(1, rounds + 1):
        t = t0 + np.concatenate([[0], np.cumsum(np.exp(steps))])
        eta = np.bincount(row, w[col], n)
        # P(y = k) = s(eta - t_{k-1}) - s(eta - t_k), with s(eta - t_{-1}) = 1 and s(eta - t_{K-1}) = 0
        s = sig(eta[:, None] - t[None, :])
        upper = np.concatenate([np.ones((n, 1)), s], 1)[np.arange(n), grade]
        lower = np.concatenate([s, np.zeros((n, 1))], 1)[np.arange(n), grade]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        g_eta = -weight * (du - dl) / p
        g_t = np.zeros(GRADES - 1)
        has_u, has_l = grade > 0, grade < GRADES - 1
        np.add.at(g_t, grade[has_u] - 1, (weight * du / p)[has_u])
        np.add.at(g_t, grade[has_l], -(weight * dl / p)[has_l])
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([np.bincount(col, g_eta[row], n_features), [tail[0]], tail[1:] * np.exp(steps)])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
        w = np.maximum(w - step[:n_features] - 0.05 * L1 / (np.sqrt(v[:n_features] / (1 - 0.999**i)) + 1e-9), 0)
        t0 -= step[n_features]
        steps = np.clip(steps - step[n_features + 1 :], -5, 3)
    return w, t0 + np.concatenate([[0], np.cumsum(np.exp(steps))])


class _Memo(dict):
    """word -> score, cleared when it gets large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = self.model.word_score(word)
        return value


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``toxic_score``, ``p_toxic`` = P(severity > 0), ``expected_severity`` and the
    most probable ``severity`` (0-3, the lower at a tie) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(shared.value)
        for batch in chunks(batches, "text"):
            names = [c for c in batch.schema.names if c != "text"]
            at = batch.schema.get_field_index("text")
            total = [math.fsum(map(memo.__getitem__, words_of(t))) for t in batch.column(at).to_pylist()]
            above = [memo.model.above(x) for x in total]
            each = [[a - b for a, b in zip([1.0, *p], [*p, 0.0], strict=True)] for p in above]
            out = [total, [p[0] for p in above], [sum(p) for p in above], [max(range(GRADES), key=lambda k: (p[k], -k)) for p in each]]  # noqa: B023
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
                [*names, "toxic_score", "p_toxic", "expected_severity", "severity"],
            )

    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    types = ", ".join([f"k{i} {t}" for i, (_, t) in enumerate(slim.dtypes[:-1])])
    out = slim.mapInArrow(run, f"{types}, toxic_score double, p_toxic double, expected_severity double, severity int")
    new = ("toxic_score", "p_toxic", "expected_severity", "severity")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *new)


#: A text is rejected from this P(severity > 0) on.
REJECT = 0.3


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from quire.session import table

    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("toxic", F.col("p_toxic") >= REJECT)
