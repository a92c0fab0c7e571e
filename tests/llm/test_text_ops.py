"""Quality rules, toxicity, decontamination and site quality against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import quality_rules, site_quality, toxicity, winnowing

TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e f g h " * 4, "x " * 30, "Line one here\nLine one here\n\nLine one here\nother",
    "WOW!! GREAT!! STUFF!! " * 12, "a | b # c $ d % e & f < g > h *" * 3, "word " * 3 + "é ü \x0b\x0c z", "\x1c a\x1cb",
    " ".join(f"w{i}" for i in range(5000)), "same same same other " * 8,
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k0 string"


def frame(spark, texts, more=()):
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *more], DOCS)


def brute_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) >= 2 if len(windows) < 200 else False:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_measures(spark):
    got = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(frame(spark, TEXTS))).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), (i, t)
        assert bool(r.fail_bits & 1) == (r.n_words < 20)
        assert r.kept == (r.fail_bits & quality_rules.mask(quality_rules.PRODUCTION) == 0)


def test_quality_policies_and_ablations(spark):
    ledger = quality_rules.ledger(frame(spark, TEXTS)).cache()
    out = {r.rule: r for r in quality_rules.ablations(ledger).collect()}
    m = quality_rules.mask(quality_rules.PRODUCTION)
    bits = [r.fail_bits & m for r in ledger.collect()]
    for rule in quality_rules.RULES:
        if rule.name in out:
            bit = 1 << rule.bit
            assert out[rule.name].n_failed == sum(bool(b & bit) for b in bits)
            assert out[rule.name].n_failed_alone == sum(b == bit for b in bits)
            assert out[rule.name].kept_without == sum(b & ~bit == 0 for b in bits)
    assert quality_rules.ledger(frame(spark, [])).count() == 0


def test_toxicity_orders_grades_and_keeps_clean(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        n = rng.randint(5, 60)
        words = rng.choices(vocabulary, k=n)
        toxic = i % 4 == 0
        for j in range(rng.randint(1, 8) if toxic else 0):
            words.insert(rng.randrange(len(words)), "zqinsult" + rng.choice(["", "er", "ing"]) if j % 2 else "zvile")
        rows.append((i, " ".join(words), "en", "s", 0, ""))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None, None), (901, "", "en", "s", 0, "")], DOCS)
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.where("doc_id % 2 = 0 OR doc_id >= 900"), lab)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if i % 2]
    wrong = [i for i in held if (got[i].p_toxic >= toxicity.REJECT) != bool(labels[i][2])]
    assert len(wrong) <= 2 and not any(labels[i][2] == 0 for i in wrong)
    assert got[900].toxic_score == got[901].toxic_score == 0 and got[900].severity == 0
    assert len(got) == 402
    few = toxicity.score(spark.createDataFrame([(1, "zvile", "", "", 0, ""), (2, "zvile zqinsult zqinsulter zqinsulting", "", "", 0, "")], DOCS), model).collect()
    severity = {r.doc_id: r.expected_severity for r in few}
    assert severity[1] < severity[2]


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, ["some text"])
    assert toxicity.score(docs, toxicity.fit(docs, empty)).first().p_toxic < 1e-6


def brute_decontaminate(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(len(w), 8)
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(d) - m + 1):
                if d[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    if item is not None:
                        ids.add(item)
    joined = ",".join(sorted(map(str, ids)))
    return len(d), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), len(ids) >= 2


@pytest.mark.parametrize("small", [10_000, 0])
def test_decontamination(spark, small):
    rng = random.Random(3)
    base = [rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randint(0, 30)) for _ in range(400)]
    items = [(i, " ".join(base[a : a + n])) for i, (a, n) in enumerate([(0, 12), (5, 9), (40, 8), (60, 7), (80, 3), (120, 1), (200, 20), (10, 8), (200, 20)])]
    items += [(6, " ".join(base[300:312])), (None, "never seen words here at all in the text"), (50, None), (51, " ... ")]
    texts = [None, "", "--", " ".join(base), " ".join(base[3:20]).upper(), " ".join(base[60:67]), " ".join(base[58:64]) + " x", " ".join(base[200:220] * 3), "zz " * 50]
    texts += [" ".join(rng.choices(base, k=80)) + " " + " ".join(base[40:48]) for _ in range(5)]
    docs = frame(spark, texts, [(3, texts[3], "en", "s", 0, "")])
    out = winnowing.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), small_windows=small).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = brute_decontaminate(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, r.doc_id


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.decontaminate(frame(spark, ["a b c"]), none).first().n_hit == 0
    assert winnowing.decontaminate(frame(spark, []), none).count() == 0


def test_site_quality_shrinks_sparse_sites(spark):
    good, bad = "plain words of a normal text that goes on for a while and says something new each time " * 2, "STOP!! NOW!! " * 20
    rows = [(i, good + str(i), "en", "clean", 0, "") for i in range(60)] + [(100 + i, bad + str(i), "en", "dirty", 0, "") for i in range(60)]
    rows += [(200, "middling Words! HERE are some of them for you to read and to think about today", "en", "clean", 0, "")]
    rows += [(201, "middling Words! HERE are some of them for you to read and to think about today", "en", "dirty", 0, "")]
    rows += [(202, "middling Words! HERE are some of them for you to read and to think about today", "fr", "rare", 0, ""), (203, None, None, None, 0, "")]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(40), *range(100, 140)]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in site_quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == 124
    assert got[0].good and not got[100].good
    assert got[201].p_good < got[202].p_good < got[200].p_good
    assert got[201].host_quality < got[202].host_quality < got[200].host_quality
    assert site_quality.classify(frame(spark, []), labels).count() == 0
    blank = site_quality.classify(frame(spark, ["a"]), labels.where("doc_id < 0")).select(F.round("p_doc", 6)).first()[0]
    assert blank == 0.5


def test_decontamination_of_a_window_in_very_many_items(spark):
    """A window that stands in thousands of items, a long text, clashing columns; both ways agree."""
    common = " ".join(f"c{i}" for i in range(8))
    items = spark.createDataFrame([(i, f"own{i} {common}") for i in range(3000)] + [(None, common)], "item_id long, text string")
    texts = [common, "x " * 40_000 + common, "nothing here", common + " " + common]
    docs = frame(spark, texts).selectExpr("*", "1 AS row", "2 AS window", "3 AS n_hit", "4 AS places")
    for small in (10, 100_000):
        got = {r.doc_id: r for r in winnowing.decontaminate(docs, items, small_windows=small).collect()}
        assert [(got[i].n_items, got[i].n_hit) for i in range(4)] == [(3000, 8), (3000, 8), (0, 0), (3000, 16)]
        assert got[0].items_sha256 == hashlib.sha256(",".join(sorted(map(str, range(3000)))).encode()).hexdigest()


def test_quality_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c", "en", "s", 0, "x"), (None, "a b c", "en", "s", 0, "x"), (1, "w " * 200_000, "en", "s", 0, "x")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words) for r in quality_rules.ledger(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit(5))).collect())
    assert got == [(0, 3, 0), (0, 3, 0), (1, 200_000, 200_000)]


def toxic_corpus(n=300):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 40)) + (["zqvile", "zqbad" + rng.choice(["", "ly"])] if i % 3 == 0 else [])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows + [(1000 + k, rows[0][1], 1) for k in range(5)]


def test_toxicity_screening_against_brute_force(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "") for d, t, _ in rows], DOCS).selectExpr("*", "1 AS toxic", "2 AS n", "3 AS words")
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows], "doc_id long, quality int, toxic int")
    sampled = toxicity.sample(docs, labels)
    vote = {r.doc_id: r.vote for r in sampled.collect()}
    assert vote[0] == pytest.approx(1 / 6) and vote[1000] == pytest.approx(1 / 6) and vote[1] == 1
    n1, n0 = (sum(vote[d] for d, _, y in rows if y == k) for k in (1, 0))
    share = lambda f, k: sum(vote[d] for d, t, y in rows if y == k and any(f in toxicity.features_of(w) for w in t.split()))
    want = []
    for f in {f for _, t, _ in rows for w in t.split() for f in toxicity.features_of(w)}:
        a, b = share(f, 1), share(f, 0)
        p = (a + b) / (n1 + n0)
        if a >= toxicity.MIN_VOTES - 1e-9 and (a / n1 - b / n0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5 >= toxicity.MIN_Z:
            want.append(f)
    assert toxicity.screened(sampled, n1, n0) == sorted(want) and "zqvile$" in want


def test_toxicity_likelihood_by_differences():
    """The fit is where no small change of a weight or threshold raises the likelihood."""
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    n, k = 400, 3
    x = rng.integers(0, 3, (n, k))
    grade = np.clip((x[:, 0] + rng.integers(0, 2, n)), 0, 3)
    row, col = np.repeat(np.arange(n), x.sum(1)), np.concatenate([np.repeat(np.arange(k), r) for r in x])
    w, t = toxicity._descend(row, col, grade, np.full(n, 1 / n), k, rounds=4000)

    def likelihood(w, t):
        cut = [-math.inf, *t, math.inf]
        s = lambda z: 1 / (1 + math.exp(-z)) if abs(z) < 700 else float(z > 0)
        return sum(math.log(s(e - cut[g]) - s(e - cut[g + 1])) for e, g in zip(x @ w, grade, strict=True)) / n

    best = likelihood(w, t)
    assert list(t) == sorted(t) and w[0] > 0.5
    for i in range(k):
        for step in (0.05, -0.05):
            if w[i] + step >= 0:
                moved = w.copy()
                moved[i] += step
                assert likelihood(moved, t) < best + 1e-4
    for i in range(3):
        for step in (0.05, -0.05):
            moved = t.copy()
            moved[i] += step
            assert likelihood(w, moved) < best + 1e-4


def test_toxicity_of_ties_long_texts_and_nothing(spark):
    model = toxicity.Model({"bad$": 3.0}, (1.0, 2.0, 3.0), 1)
    docs = frame(spark, ["bad", "bad", "x " * 300_000 + "bad", None]).selectExpr("*", "1 AS severity", "2 AS p_toxic")
    got = toxicity.score(docs, model).orderBy("doc_id").collect()
    assert got[0][1:] == got[1][1:] == got[2][1:] and got[3].severity == 0
    p = [1 / (1 + 2.718281828459045 ** (t - 3.0)) for t in model.thresholds]
    assert got[0].p_toxic == pytest.approx(p[0]) and got[0].expected_severity == pytest.approx(sum(p))
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_site_posteriors_against_brute_force(spark):
    """Group posteriors recomputed from the documents' own probabilities; repeated rows and null sites count."""
    rng = random.Random(2)
    text = lambda good: " ".join(rng.choices("plain words of some text here".split(), k=30)) if good else "BUY!! NOW!! " * rng.randint(5, 12)
    rows = [(i, text(rng.random() < (0.9 if i % 5 else 0.2)), ["en", "de", None][i % 3], [f"h{i % 5}", None][i % 7 == 6], 0, "k") for i in range(300)]
    rows += [rows[3], rows[3]]
    labels = spark.createDataFrame([(d, int(not t.startswith("BUY")), 0) for d, t, *_ in rows[:150]], "doc_id long, quality int, toxic int")
    got = site_quality.classify(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS host", "2 AS path", "3 AS total"), labels).collect()
    assert len(got) == 302
    groups = lambda key: {k: [r.p_doc for r in got if key(r) == k] for k in {key(r) for r in got}}
    hosts, paths = groups(lambda r: r.host), groups(lambda r: (r.host, r.path))
    mean = sum(r.p_doc for r in got) / len(got)

    def strength(gs):
        n, sizes = sum(map(len, gs)), [len(g) for g in gs]
        ss = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in gs)
        between = (ss - (len(gs) - 1) * mean * (1 - mean)) / (n - sum(x * x for x in sizes) / n)
        return min(1000.0, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1000.0

    sh, sp = strength(list(hosts.values())), strength(list(paths.values()))
    host_q = {h: (sum(g) + sh * mean) / (len(g) + sh) for h, g in hosts.items()}
    for r in got:
        g = paths[r.host, r.path]
        assert r.host_quality == pytest.approx(host_q[r.host])
        assert r.path_quality == pytest.approx((sum(g) + sp * host_q[r.host]) / (len(g) + sp))
    import math

    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        assert r.p_good == pytest.approx(1 / (1 + math.exp(-(logit(r.p_doc) + 0.5 * (logit(r.path_quality) - logit(mean))))))


def test_the_hierarchy_lowers_held_out_loss(spark):
    """Where the text says little, its site says more: log loss on rows that the fit hasn't seen."""
    import math

    rng = random.Random(12)
    rows, labels, truth = [], [], {}
    for i in range(1500):
        host = f"h{i % 30}"
        good = rng.random() < (0.92 if i % 30 < 15 else 0.08)
        shouts = sum(rng.random() < (0.35 if good else 0.65) for _ in range(4))  # weak evidence
        rows.append((i, " ".join(["plain", "words", "of", "text"] * 6 + ["LOUD!!"] * shouts), "en", host, 0, ""))
        truth[i] = good
        if i < 500:
            labels.append((i, int(good), 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [r for r in site_quality.classify(spark.createDataFrame(rows, DOCS), lab).collect() if r.doc_id >= 500]
    loss = lambda c: -sum(math.log(r[c] if truth[r.doc_id] else 1 - r[c]) for r in got) / len(got)
    assert loss("p_good") < loss("p_doc") - 0.02
