"""Quality by hierarchical empirical Bayes: documents within paths within hosts.

1. A document classifier (logistic, over a few measures of the text) gives each
   document a probability of being good. It is fitted on a bounded sample of
   labelled rows: at most ``MAX_ROWS`` of each label, by the hash of the id.
2. Grouped sums of these probabilities give, for every host and for every path
   within it, a beta posterior. A host is shrunk towards the global mean by a
   prior of ``s`` pseudo-documents, and a path towards its host in the same way;
   ``s`` is estimated by moments from the spread of the groups, so sparse sites
   stay near their parents and large ones speak for themselves.
3. The document's own log-odds are combined with what its path adds over the
   global prior, damped by ``SITE_WEIGHT``: evidence about the site moves what the
   text leaves open.

The host is the ``source`` and the path the language within it, unless other
columns are named. Group sums are pre-aggregated before their shuffle; they are
broadcast back only after a count (``SMALL_GROUPS``), otherwise joined over salts.

Defined cases: null hosts and paths are groups of their own; null and empty texts
have all measures 0; without labels of both kinds the classifier says one half;
repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.quality_rules import measure
from quire.session import written

MAX_ROWS = 5000
SMALL_GROUPS = 100_000
SALTS = 16
SITE_WEIGHT = 0.5
PRIOR_BOUNDS = (2.0, 1000.0)
GOOD_FROM = 0.5

#: Measures as SQL, each about 0 to 1.
FEATURES = {
    "short": "1 / (1 + n_words / 20D)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "symbols": "least(n_symbols / greatest(n_words, 1), 3)",
    "shouts": "n_upper / greatest(ascii_letters, 1)",
    "exclaims": "least(n_exclaims / greatest(n_words, 1), 3)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "stutters": "n_stutters / greatest(n_words, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1), 30) / 30",
}


def features(measured: DataFrame, keep: list[str]) -> DataFrame:
    return measured.selectExpr(*keep, *(f"CAST({e} AS DOUBLE) AS {name}" for name, e in FEATURES.items()))


def fit(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights of the features and, last, the intercept; at most 2 * max_rows rows reach the driver."""
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    ids = [each.where(F.col("good") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for v in (0, 1)]
    totals = {r.good: r.n for r in each.groupBy("good").agg(F.count("*").alias("n")).collect()}
    got = rows.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("doc_id", "good", *FEATURES).toArrow().sort_by([("doc_id", "ascending"), *((f, "ascending") for f in FEATURES)])
    y = got["good"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return np.zeros(len(FEATURES) + 1)
    x = np.column_stack([*(got[f].to_numpy() for f in FEATURES), np.ones(len(y))])
    stands = np.where(y > 0, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    return _newton(x, y, stands / stands.sum())


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-documents of the prior, by moments: the spread of the group means beyond
    what their sizes explain; ``groups``: (n, total)."""
    r = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("total") / F.col("n") - mean) ** 2).alias("ss"), F.sum(F.col("n") ** 2).alias("n2")).first()
    if not r.g or r.g < 2:
        return PRIOR_BOUNDS[1]
    between = (r.ss - (r.g - 1) * mean * (1 - mean)) / max(r.n - r.n2 / r.n, 1e-9)
    return min(PRIOR_BOUNDS[1], max(PRIOR_BOUNDS[0], mean * (1 - mean) / between - 1)) if between > 0 else PRIOR_BOUNDS[1]


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, host, path, p_doc, host_quality, path_quality, p_good, good) of every document."""
    named = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    measured = measure(named, "text", ("doc_id", "host", "path"))
    rows = written(features(measured, ["doc_id", "host", "path"]), "site-measures")
    w = fit(rows, labels)
    eta = sum((F.col(f) * float(w[i]) for i, f in enumerate(FEATURES)), F.lit(float(w[-1])))
    key = F.to_json(F.struct(F.array("host", "path").alias("k")))
    scored = rows.select("doc_id", "host", "path", key.alias("key"), (1 / (1 + F.exp(-eta))).alias("p_doc"))
    paths = written(scored.groupBy("host", "path", "key").agg(F.count("*").alias("n"), F.sum("p_doc").alias("total")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = all_.total / all_.n if all_.n else 0.5
    s_host, s_path = strength(hosts, mean), strength(paths, mean)
    hosts = hosts.select(F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("hk"), ((F.col("total") + s_host * mean) / (F.col("n") + s_host)).alias("host_quality"))
    site = paths.withColumn("hk", F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))).join(hosts, "hk")
    site = site.select("key", "host_quality", ((F.col("total") + s_path * F.col("host_quality")) / (F.col("n") + s_path)).alias("path_quality"))
    if paths.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS:
        joined = scored.join(F.broadcast(site), "key")
    else:
        site = site.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(site, ["key", "salt"])
    prior = math.log(max(mean, 1e-6) / max(1 - mean, 1e-6))
    odds = _logit(F.col("p_doc")) + SITE_WEIGHT * (_logit(F.col("path_quality")) - prior)
    out = joined.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", "p_doc", "host_quality", "path_quality", "p_good", (F.col("p_good") >= GOOD_FROM).alias("good"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.session import table

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
