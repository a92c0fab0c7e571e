"""Similarity join, mixing and language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import context_mixing, jaccard_join, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def edited(rng, words, k, vocabulary):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_join(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for t in (None, "", "  ", "one", "One", "one two", "one two three four", "one two three four five"):
        add(t)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 6)):
            add(" ".join(edited(rng, base, rng.randint(0, 5), vocabulary)))
    chain = rng.choices(vocabulary, k=80)  # each is near the next, the ends are not near each other
    for _ in range(12):
        chain = edited(rng, chain, 1, vocabulary)
        add(" ".join(chain))
    shared = rng.choices(vocabulary, k=40)
    for _ in range(25):
        add(" ".join(shared + rng.choices(vocabulary, k=rng.randint(5, 60))))
    rows.append((3, "one"))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar(docs).collect())
    assert got == brute_components(rows)


def test_similarity_join_hot_buckets(spark, monkeypatch):
    """Buckets that are split into parts and blocks find the same components; columns may clash."""
    monkeypatch.setattr(jaccard_join, "REST_MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 8)
    monkeypatch.setattr(jaccard_join, "SALTS", 2)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = rng.choices(vocabulary, k=60)
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 9), vocabulary))) for i in range(60)]
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).selectExpr("*", "1 AS cls", "2 AS n", "3 AS fragment", "4 AS root")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar(docs, hot=4).collect())
    assert got == brute_components(rows)


def test_components_by_steps(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, rng.randint(101, 140)) for _ in range(30)] + [(a, b) for a, b in ((200, 205), (205, 203), (203, 201))]
    df = spark.createDataFrame(links, "a long, b long")
    rows = lambda few: {(r.node, r.root) for r in jaccard_join.components(df, few).collect()}
    assert rows(0) == rows(1000) and (40, 0) in rows(0) and (205, 200) in rows(0)


@pytest.mark.parametrize("block", [1, 3, 500])
def test_blocks_of_a_bucket_meet_once(spark, monkeypatch, block):
    """All pairs of a bucket whose sizes may link meet, each once, whatever the blocks."""
    monkeypatch.setattr(jaccard_join, "REST_MEMBERS", block)
    n = {c: 20 + (c * 7) % 60 for c in range(40)}
    found = spark.createDataFrame([(1, 40, c, n[c], 0, n[0], n[c], n[0]) for c in n], "bucket long, size long, cls long, n long, rep long, rep_n long, spare long, rep_spare long")
    roots = spark.createDataFrame([], "node long, root long")
    checked = spark.createDataFrame([], "a long, b long, linked boolean, near double, far double, o long")
    parts = spark.createDataFrame([(c, jaccard_join.SKETCH, [0] * 16) for c in n], "cls long, f int, shingles array<bigint>")
    got = Counter((r.a, r.b) for r in jaccard_join.rest_pairs(found, roots, checked, parts).collect())
    want = {(a, b) for a in n for b in n if a < b and 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b])}
    assert got == Counter(want)


def test_levels_of_very_common_shingles():
    """Counts far beyond 2**15 keep their level, and with it the number of their parts."""
    import numpy as np
    import pyarrow as pa

    low = np.array([7, 9], np.uint32)
    rows = [(0, low.tobytes(), np.array([1 << 16, 1], np.uint32).tobytes())] * 32
    out = jaccard_join._levels()(pa.table({c: pa.array(v, k) for c, v, k in zip(("part", "low", "counts"), zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)}))
    assert sorted(np.frombuffer(out["levels"][0].as_py(), np.uint8).tolist()) == [5, 21]


def test_similarity_join_of_nothing(spark):
    assert jaccard_join.similar(spark.createDataFrame([], DOCS)).count() == 0
    one = jaccard_join.similar(spark.createDataFrame([(None, "a b c d e f", "", "", 0), (None, "a b c d e f", "", "", 0)], DOCS)).collect()
    assert [(r.n_shingles, r.component_id) for r in one] == [(2, None)] * 2


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0)
    free = set(names)
    while True:
        rest = total - sum(target[s] for s in names if s not in free)
        for s in free:
            target[s] = rest * w[s] / sum(w[x] for x in free)
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= over


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["b", "a", "ä", "z", None, "big", "big", "big"]), 0) for i in range(400)]
    rows += [(3, "a b", "en", "a", 0), (3, "a b", "en", "a", 0), (None, "x y z", "en", "a", 0), (999, None, "en", "empty", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(4, 0.02 * want[s]), s
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rs: Counter((r.doc_id, r.size, r.taken) for r in rs if r.doc_id != 3)
    assert key(got) == key(again)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_schedule_is_even(spark):
    """Any stretch of the schedule is close to the target shares."""
    rows = [(i, "w " * 50, "en", "abc"[i % 3], 0) for i in range(60)]
    out = mixing.pieces(spark.createDataFrame(rows, DOCS), block=1).where("slot IS NOT NULL").collect()
    order = sorted({(r.slot, r.source) for r in out})
    target = {r.source: r.target for r in out}
    total = sum(target.values())
    for lo in range(0, len(order) - 500, 700):
        seen = Counter(s for _, s in order[lo : lo + 500])
        for s, t in target.items():
            assert abs(seen[s] - 500 * t / total) <= 12


def test_many_sources_in_ranges(spark, monkeypatch):
    """Numbers, cuts and cumulative targets over several ranges of sources; columns that clash."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60), "x", f"host{rng.randint(0, 150)}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS row", "3 AS key", "4 AS target", "5 AS p")
    sizes, taken = defaultdict(int), Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    for r in mixing.mix(docs).collect():
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(want[s] - 1.001 <= taken[s] <= want[s] + 0.001 for s in sizes)


@pytest.mark.parametrize("n", [1_000_000, 4_000_000])
def test_schedule_of_millions_of_slots_is_even(spark, n):
    """Largest gap and star discrepancy, in slots."""
    import numpy as np

    i = spark.range(n)
    u = np.sort(i.select(mixing.point(i.id).alias("u")).toArrow()["u"].to_numpy())
    assert 0 <= u[0] and u[-1] < 1
    assert np.diff(u).max() * n < 1.7
    at = np.arange(n)
    assert max((u * n - at).max(), (at + 1 - u * n).max()) < 5


@pytest.mark.parametrize("block", [1, mixing.BLOCK, 5000])
def test_small_sources_reach_their_targets(spark, block):
    """Sources of 100 to 10,000 words beside a large one."""
    small = {"a": 100, "c": 300, "e": 1000, "g": 2000, "i": 5000, "k": 10_000}
    rows = [(i, "w " * 5000, "en", "big", 0) for i in range(80)]
    rows += [(1000 + i, "w " * (n // 4), "en", s, 0) for s, n in small.items() for i in range(4)]
    out = mixing.pieces(spark.createDataFrame(rows, DOCS), block=block).collect()
    taken, target = Counter(), {r.source: r.target for r in out}
    for r in out:
        if r.slot is not None:
            taken[r.source] += r.hi - r.lo
            assert 0 <= r.slot < math.ceil(sum(target.values()) / block)
    for s in small:
        assert taken[s] == math.floor(target[s]), s
    assert max(Counter((r.row, r.slot, r.lo, r.hi) for r in out).values()) <= mixing.MOST


def tokens(text):
    return [w.lower() if w.isascii() else w for w in re.findall("[^\x20\x09-\x0d]+", text or "")] + [""]


def test_language_model(spark):
    rng = random.Random(11)
    syllables = ["ka", "to", "mi", "ra", "ne", "su"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 80))), "en", "s", 0) for i in range(300)]
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "xqz " * 300, "en", "s", 0), (1003, "a" * 30_000, "en", "s", 0), (None, "ka to", "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = context_mixing.score_texts(docs).collect()
    assert len(got) == len(rows)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(t)
    for r in got:
        ws = tokens(texts[r.doc_id][0])
        assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.n_tokens == len(ws)
        assert r.n_known == sum(w in counts for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    normal = [r.bits_per_byte for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    rng2 = random.Random(2)
    noise = spark.createDataFrame([*rows, *((5000 + i, "".join(rng2.choices("bcdfghjlpqvwxyz", k=40)), "en", "s", 0) for i in range(40))], DOCS)
    odd = [r.bits_per_byte for r in context_mixing.score_texts(noise).collect() if r.doc_id is not None and r.doc_id >= 5000 and r.held_out]
    assert odd and sum(odd) / len(odd) > 1.5 * sum(normal) / len(normal)


CORPUS = "the cat sat on the mat. a dog sat by the cat and the dog ran. le chat est sur le tapis et le chien court."


def corpus_of(rng, n, start=0):
    words = CORPUS.split()
    rows = []
    for i in range(start, start + n):
        at = [rng.randrange(len(words))]
        for _ in range(rng.randint(3, 60)):
            at.append((at[-1] + 1) % len(words) if rng.random() < 0.9 else rng.randrange(len(words)))
        text = [words[k] for k in at] + ["q" + "".join(rng.choices("abcdef", k=3)) for _ in range(rng.randint(0, 2))]
        rows.append((i, " ".join(text), "en", "s", 0))
    return rows


def test_codes_are_a_prefix_code():
    import numpy as np

    rng = random.Random(1)
    count = np.array([rng.choice([2, 3, 5, 1000, 70_000]) for _ in range(300)] + [1])
    place = np.cumsum(count) - count
    total = int(count.sum())
    codes = context_mixing.codes_of(place, count, total)
    spelled = []
    for c, n, at in zip(codes.tolist(), count.tolist(), place.tolist(), strict=True):
        length = c & 63
        assert 2 ** (length - 1) * n >= total and (length == 1 or 2 ** (length - 2) * n < total)
        assert c >> 6 == (2 * at + n) * 2**length // (2 * total)
        spelled.append(format(c >> 6, f"0{length}b"))
    spelled.sort()
    assert not any(b.startswith(a) for a, b in zip(spelled, spelled[1:], strict=False))


def test_scores_against_a_plain_bit_model(spark, monkeypatch):
    """The same bits, contexts without hashing, counts in dictionaries and one bit at a time; weights are taken as learned."""
    import numpy as np

    monkeypatch.setattr(context_mixing, "WORD_BITS", (22,) * 4)
    monkeypatch.setattr(context_mixing, "BYTE_BITS", (22,) * 6)
    monkeypatch.setattr(context_mixing, "DEEP", 6)
    monkeypatch.setattr(context_mixing.Shape, "__init__", wide(context_mixing.Shape.__init__))
    rows = corpus_of(random.Random(3), 120) + [(900, None, "", "", 0), (901, "zzzzz zzzzz zzzzz", "", "", 0)]
    coded, book = context_mixing.code_texts(spark.createDataFrame(rows, DOCS))
    shape, shared, learned = context_mixing.train(coded, book)
    model = context_mixing.Model(shape, shared.value)
    for mixer, values in zip(model.mixers, learned, strict=True):
        mixer.learned(values)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    got = {r.doc_id: r for r in coded.collect()}
    value = {}
    for d, t, *_ in rows:  # the code book as the texts show it
        for w, v in zip(tokens(t), context_mixing.numbers(got[d].codes, np.uint64).tolist(), strict=True):
            assert value.setdefault(w, v) == v
    train = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    once, twice = (sum(n == k for n in train.values()) for k in (1, 2))
    rare = once + 2 * twice
    assert book.total == sum(n for n in train.values() if n > 2) + rare and once > 5 and twice > 2
    assert len({v for w, v in value.items() if train[w]}) == sum(w in value for w in train)
    listed = (2 * twice + 1) / (rare + 2)

    def events(text, learning):
        """(token, kind, bit, contexts, depth) of every bit, and what else an escape costs."""
        before, frequent = None, None
        for i, w in enumerate(tokens(text)):
            n = train[w] - learning
            escape = train[w] <= 2
            code = int(book.escape) if escape else value[w]
            if escape and n:
                yield i, None, math.log(listed * n / rare), None, None
            elif escape:
                yield i, None, math.log(1 - listed), None, None
            bits = format(code >> 6, f"0{code & 63}b")
            tail = before[-3:] if before is not None else None
            for k, b in enumerate(bits):
                node = bits[:k]
                if k < 6:
                    yield i, 0, int(b), [node, (before, node), (tail, node), (frequent, node)], (k >= 4) + (k >= 9)
                else:
                    yield i, 1, int(b), [node], 0
            if escape and not n:
                data = w.encode() + b" "
                for j, byte in enumerate(data):
                    at, n_bits = int(shape.code.start[byte]), int(shape.code.length[byte])
                    crossing = (data[:j], tail)
                    last = lambda k: ("in", data[j - k : j]) if j >= k else crossing  # noqa: B023, E731
                    for k in range(n_bits):
                        node = int(shape.code.node[at + k])
                        yield i, 2, int(shape.code.bit[at + k]), [*((k2, last(k2), node) for k2 in range(1, 5)), (data[:j], node), (frequent, last(2), node)], int(k > 0)
            before = w
            if (value[w] & 63) <= context_mixing.FREQUENT:
                frequent = w

    table = {0: (0, 1, 2, 3), 1: (0,), 2: (4, 5, 6, 7, 8, 9)}
    counts = defaultdict(lambda: [0, 0])
    for d, t, *_ in rows:
        if not held(d):
            for _, kind, bit, contexts, _ in events(t, True):
                for i, c in zip(table.get(kind, ()), contexts or (), strict=True):
                    counts[i, c][bit] += 1
    edges = lambda n, cuts: sum(n >= c for c in cuts)
    kinds = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"
    for r in coded.mapInArrow(context_mixing._score(shape, shared, learned), kinds).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        each = [0.0] * len(tokens(text))
        for i, kind, bit, contexts, depth in events(text, False):
            if kind is None:
                each[i] += bit
                continue
            n = [counts.get((j, c), (0, 0)) for j, c in zip(table[kind], contexts, strict=True)]
            seen = list(map(sum, n))
            if kind == 2:
                gate = (edges(seen[4], (0.5, 3.5, 31.5)) * 3 + edges(seen[3], (0.5, 7.5))) * 2 + depth
            elif kind == 1:
                gate = edges(seen[0], (0.5, 7.5, 63.5))
            else:
                gate = (edges(seen[1], (0.5, 7.5, 63.5)) * 3 + edges(seen[2], (0.5, 63.5))) * 3 + depth
            mixer = model.mixers[kind]
            z = sum(float(w) * x for w, x in zip(mixer.weights[:, gate], [*(math.log((b + 0.15) / (a + 0.15)) for a, b in n), 0.3], strict=True))
            z = max(-14.0, min(14.0, z))
            u = (max(-7.999, min(7.999, z)) + 8) * 2
            lo, part = int(u), u - int(u)
            curve = mixer.refine[gate * context_mixing.BINS :]
            z = 0.5 * z + 0.5 * (curve[lo] * (1 - part) + curve[lo + 1] * part)
            each[i] -= math.log1p(math.exp(-z if bit else z))
        assert r.score == pytest.approx(brute_adapted(each, tokens(text)) / math.log(10), rel=1e-3, abs=1e-3), r.doc_id


def wide(old):
    def init(self, book, code):
        old(self, book, code)
        tokens, book.tokens = book.tokens, 1 << 21
        old(self, book, code)
        book.tokens = tokens

    return init


def brute_adapted(log_p, words):
    """Two caches, each a running Bayesian mixture over its strengths."""
    for strengths, context in ((context_mixing.STRENGTHS, False), (context_mixing.AFTER, True)):
        total, out, seen, places = [0.0] * len(strengths), [], Counter(), Counter()
        for i, w in enumerate(words):
            key = (words[i - 1] if i else None) if context else None
            before = [math.fsum(map(math.exp, (x - max(total) for x in total))), max(total)]
            total = [x + math.log((seen[key, w] + a * math.exp(log_p[i])) / (places[key] + a)) for x, a in zip(total, strengths, strict=True)]
            after = [math.fsum(map(math.exp, (x - max(total) for x in total))), max(total)]
            out.append(math.log(after[0]) + after[1] - math.log(before[0]) - before[1])
            seen[key, w] += 1
            places[key] += 1
        log_p = out
    return sum(log_p)


def test_order_matters_and_columns_may_clash(spark):
    """Shuffled held-out texts score lower than the texts; other columns don't matter."""
    rng = random.Random(8)
    rows = corpus_of(rng, 400)
    held = [r for r in corpus_of(rng, 200, 1000) if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    shuffled = []
    for d, t, *rest in held:
        d2 = next(x for x in range(100_000 * d, 100_000 * d + 100) if zlib.crc32(str(x).encode()) % 7 == 2)
        words = t.split()
        rng.shuffle(words)
        shuffled.append((d2, " ".join(words), *rest))
    docs = spark.createDataFrame(rows + held + shuffled, DOCS)
    score = {r.doc_id: r.score for r in context_mixing.score_texts(docs.selectExpr("*", "1 AS block", "2 AS part", "'x' AS codes")).collect()}
    assert sum(score[s[0]] for s in shuffled) < 1.2 * sum(score[h[0]] for h in held)
    assert sum(score[h[0]] > score[s[0]] for h, s in zip(held, shuffled, strict=True)) > 0.9 * len(held)


def test_every_training_text_teaches_the_weights(spark):
    """Weights and refinement see each bit of all training texts, however large the corpus."""
    import numpy as np

    coded, book = context_mixing.code_texts(spark.createDataFrame(corpus_of(random.Random(5), 200), DOCS))
    book.tokens = 10**9  # as in a large corpus
    _, _, learned = context_mixing.train(coded, book)
    bits = 0
    for r in coded.where("NOT held_out").collect():
        for v in context_mixing.numbers(r.codes, np.uint64).tolist():
            bits += v & 63 if v & 63 < int(context_mixing.NEW) else int(book.escape) & 63
    assert bits > 20_000
    assert learned[context_mixing.WORDS][-1] + learned[context_mixing.REST][-1] == bits
    for kind, values in enumerate(learned):
        n = context_mixing.GATES[kind] * context_mixing.BINS
        assert values[-1 - 2 * n : -1 - n].sum() == pytest.approx(values[-1])


def test_tokens_are_cut_as_split_cuts_them():
    texts = [b"", "A b\x00É \x1c\x85 Zz\t\n a".encode(), b" \x0b\x0c\r", b"x", b"y z ", "\u3000Ä\u00a0".encode(), b""]
    flat, n_tokens, n_bytes = context_mixing._tokens(texts)
    want = [t.translate(context_mixing.LOWER).split() for t in texts]
    assert flat.to_pylist() == [w for words in want for w in [*words, b""]]
    assert n_tokens.tolist() == [len(words) + 1 for words in want]
    assert n_bytes.tolist() == [len(b"".join(words)) for words in want]


@pytest.mark.parametrize("learning", [False, True])
def test_slots_of_three_bits_share_a_group(spark, learning):
    """Bits 0 to 2 of a code, 3 to 5 and so on, look into one aligned group of each context's table, at different places."""
    import numpy as np

    coded, book = context_mixing.code_texts(spark.createDataFrame(corpus_of(random.Random(6), 60), DOCS))
    book.tokens = 10**9
    shape = context_mixing.Shape(book, context_mixing.Code(np.arange(256)))
    got = coded.collect()
    texts = context_mixing.Texts([r.codes for r in got], [r.tails for r in got], [r.spelled for r in got], shape, learning)
    of_token, of_byte = defaultdict(list), []
    for bits in texts.steps():
        at = [s.astype(np.int64) >> learning for s in bits.slots]
        assert not learning or all(((s & 1) == bits.bit).all() for s in bits.slots)
        for j, t in enumerate(bits.owner.tolist()):
            if bits.kind == context_mixing.WORDS:
                of_token[t].append([int(x[j]) for x in at[1:]])
        if bits.kind == context_mixing.BYTES:
            of_byte += [(int(d), [int(x[j]) for x in at]) for j, d in enumerate(bits.depth)]
    runs = list(of_token.values())
    for depth, slots in of_byte:
        runs += [] if depth else [[]]
        runs[-1].append(slots)
    assert len(runs) > 500 and (of_byte or not learning)
    for run in runs:
        for i in range(0, len(run), 3):
            for column in zip(*run[i : i + 3], strict=True):
                assert len({x >> 3 for x in column}) == 1 and len(set(column)) == len(column)


def test_slices_of_counts_and_earlier_places():
    import numpy as np

    rng = np.random.default_rng(4)
    for counts in (np.array([0, 255, 256, 7], np.uint32), np.array([2**40, 0, 3]), np.zeros(5, np.uint32), rng.integers(0, 600, 1000)):
        assert context_mixing._slice(context_mixing._packed(counts)).tolist() == counts.tolist()
    key = rng.integers(0, 40, 500).astype(np.uint64) * context_mixing.ODD
    seen = Counter()
    for k, n in zip(key.tolist(), context_mixing._seen_before(key).tolist(), strict=True):
        assert n == seen[k]
        seen[k] += 1


def test_empty_corpus(spark):
    assert context_mixing.score_texts(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("kind", [context_mixing.WORDS, context_mixing.REST, context_mixing.BYTES])
def test_a_step_of_learning_and_its_costs_against_loops(kind):
    """Products over all gates at once give each gate's own gradient, and lines from bin to bin the refinement between them."""
    import numpy as np

    rng = np.random.default_rng(kind)
    parts = {context_mixing.WORDS: {1: (0, 9, 18, 27), 2: (0, 3, 6)}, context_mixing.REST: {0: (0, 1, 2, 3)}, context_mixing.BYTES: {4: (0, 6, 12, 18), 3: (0, 2, 4)}}[kind]
    mixer, n = context_mixing.Mixer(kind), 700
    stretched = (4 * rng.standard_normal((mixer.n, 50))).astype(np.float32)
    seen = np.zeros((mixer.n, 50), np.uint32)
    for i, values in parts.items():
        seen[i] = rng.choice(values, 50)
        stretched[i].view(np.uint32)[:] = stretched[i].view(np.uint32) & ~np.uint32(31) | seen[i]
    at = [rng.integers(0, 50, n) for _ in range(mixer.n)]
    slots = [(a + 50 * i).astype(np.uint32) for i, a in enumerate(at)]
    bit, depth = rng.integers(0, 2, n).astype(np.uint8), {context_mixing.WORDS: 2, context_mixing.REST: 0, context_mixing.BYTES: rng.integers(0, 2, n).astype(np.uint8)}[kind]
    weights = (0.3 * rng.standard_normal(mixer.weights.shape)).astype(np.float32)
    mixer.weights[:] = weights
    bits = context_mixing.Bits(kind, bit, np.arange(n), slots, depth)
    mixer.learn(bits, stretched.reshape(-1))
    gate = sum(seen[i][at[i]].astype(int) for i in parts) + depth
    x = np.stack([*(stretched[i][at[i]] for i in range(mixer.n)), np.full(n, 0.3)]).astype(float)
    z = np.clip((weights[:, gate] * x).sum(0), -14, 14)
    want = weights.astype(float)
    for g in set(gate.tolist()):
        own = gate == g
        gradient = ((1 / (1 + np.exp(-z[own])) - bit[own]) * x[:, own]).mean(1)
        want[:, g] -= context_mixing.RATE * gradient / np.sqrt(gradient**2 + 1e-6)
        assert mixer.stats.reshape(2, mixer.gates, -1)[0, g].sum() == own.sum()
    assert np.allclose(mixer.weights, want, atol=2e-3) and mixer.mass == n
    mixer.learned(mixer.packed())
    cost = mixer.cost(bits, stretched.reshape(-1))
    z = np.clip((mixer.weights[:, gate] * x).sum(0), -14, 14)
    u = (np.clip(z, -7.999, 7.999) + 8) * 2
    lo = u.astype(int)
    curve = mixer.refine.reshape(mixer.gates, -1).astype(float)
    z = (z + curve[gate, lo] * (1 - u + lo) + curve[gate, lo + 1] * (u - lo)) / 2
    assert np.allclose(cost, np.log1p(np.exp(np.where(bit == 1, -z, z))), atol=1e-4)


def test_words_are_numbered_as_they_come():
    blobs = [b"b a b  c", b"", b" a", "é b é".encode(), b"b"]
    words, at = context_mixing._numbered([context_mixing._split(x) for x in blobs])
    assert words == list(dict.fromkeys(w for x in blobs for w in x.split(b" ")))
    assert [[words[i] for i in a] for a in at] == [x.split(b" ") for x in blobs]
    assert context_mixing._numbered([]) == ([], [])


def test_keys_that_only_differ_in_their_lowest_bits():
    import numpy as np

    key = np.array([8, 9, 8, 10, 9, 8], np.uint64)
    assert context_mixing._seen_before(key).tolist() == [0, 0, 1, 0, 1, 2]


def test_adaptation_some_texts_at_a_time(monkeypatch):
    """However few tokens go together, every text's adaptation is the same."""
    import numpy as np

    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 40, 50)
    ident, log_p = rng.integers(0, 30, lengths.sum()).astype(np.uint64), -10 * rng.random(lengths.sum())
    whole = context_mixing.adapted(log_p, ident, lengths)
    for limit in (1, 60):
        monkeypatch.setattr(context_mixing, "ADAPTED", limit)
        assert np.allclose(context_mixing.adapted(log_p, ident, lengths), whole, rtol=1e-9)


def test_a_worker_prepares_its_tables_once_for_each_pass():
    from types import SimpleNamespace

    import numpy as np

    book = SimpleNamespace(tokens=50)
    shape = context_mixing.Shape(book, context_mixing.Code(np.arange(256)))
    shared = SimpleNamespace(value=np.random.default_rng(1).integers(0, 9, 2 * shape.size).astype(np.float32))
    for learning in (True, False, True):
        one, again = (context_mixing._prepared(shape, shared, learning) for _ in range(2))
        fresh = context_mixing.Model(shape, shared.value)
        fresh.prepare(learning)
        assert again.stretched is one.stretched and np.array_equal(one.stretched, fresh.stretched)
        assert again.mixers is not one.mixers
