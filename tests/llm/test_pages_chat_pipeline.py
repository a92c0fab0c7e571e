"""WARC round trips, main text, chat formats, and the pipeline against its parts by brute force."""

import hashlib
import io
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat_format, html_text, warc
from quire.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, payload string, digest string"


def test_warc_round_trip(spark, tmp_path):
    big, huge = "<p>é" + "x" * 1200, "<p>" + "".join(map(str, range(200_000)))
    html = [None, "", "small", "small", big, big, big + "!", huge, "\r\n\r\nWARC/1.1\r\n\r\n" * 90]
    rows = [(i, f"http://x/{i}\n%0A", h, "clash", "clash") for i, h in enumerate(html)] + [(None, None, big, "", ""), (5, "again", big, "", "")]
    folder = f"file://{tmp_path}/warc"
    n = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, PAGES)), folder)
    assert n == len(rows)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    texts = {(r[0], r[1]): (r[2] or "").encode() for r in rows}
    for r in got:
        payload = texts[(r.page_id, r.url or None)]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        revisit = payload == big.encode() and r.page_id != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert r.payload == (b"" if revisit else payload)


def test_warc_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.write_archives(warc.with_revisits(spark.createDataFrame([], PAGES)), folder) == 0
    assert warc.read_archives(spark, folder).count() == 0


def test_warc_reader_is_incremental_and_strict():
    good = warc.record_bytes(1, "u", b"body", hashlib.sha1(b"body").hexdigest())

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    assert list(warc.members(Slow(warc.member(good) * 3))) == [good] * 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(warc.member(good)[:-9])))
    with pytest.raises(ValueError):
        warc.parse_record(good[:-5])
    changed = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = changed.compress(good.replace(b"body", b"bodx")) + changed.flush()
    assert [r[-1] for r in warc._records(io.BytesIO(data))] == [False]


def test_warc_check_raises(spark, tmp_path):
    """A changed payload, a wrong length and a revisit without its response are found; salted and broadcast joins agree."""
    big = "<p>" + "x" * 1500
    pages = spark.createDataFrame([(i, "u", big, "", "") for i in range(4)] + [(9, "v", "small", "", ""), (None, "w", None, "", "")], PAGES)
    salted = {tuple(r) for r in warc.with_revisits(pages, small=0).collect()}
    assert salted == {tuple(r) for r in warc.with_revisits(pages).collect()}
    folder = f"file://{tmp_path}/ok"
    warc.write_archives(warc.with_revisits(pages), folder)
    records = warc.read_archives(spark, folder).cache()
    warc.check(records)
    with pytest.raises(ValueError, match="revisits without"):
        warc.check(records.where("record_type = 'revisit'"))
    with pytest.raises(ValueError, match="revisits without"):
        warc.check(records.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", F.col("payload_bytes") + 1).otherwise(F.col("payload_bytes"))))
    digest = hashlib.sha1(b"body").hexdigest()
    for changed in (b"Payload-Length: 5", b"Payload-Length: 4"):
        raw = warc.record_bytes(1, "u", b"body", digest).replace(b"Payload-Length: 4", changed)
        assert next(warc._records(io.BytesIO(warc.member(raw))))[-1] == (changed[-1:] == b"4")
    with pytest.raises(ValueError, match="differs from their headers"):
        warc.check(records.withColumn("digest_ok", F.col("page_id") != 9))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<article></article>", ""),
        ("<nav><a>x</a></nav><article><h1>T</h1><p>a\n  b<b>c</b><p>d<br>e</article><footer>f</footer>", "T a bc d e"),
        ("<script>if (a<b) '</p>'</script><p>kept text</p><style>p{}</style>", "kept text"),
        ("<main><p>x</p><div class='comments'><p>bad</p></div><aside>no</aside><form>f<input></form></main>", "x"),
        ("<div class=ad>buy</div><div id='cookie-notice'>c</div><div><p>one</p><p>two &lt;&#233;&nbsp;z</p></div>", "one two <é z"),
        ("<body><article><p>cut off <b>here", "cut off here"), ("<ul><li>a<li>b</ul>", "a b"), ("<!-- x --><p>y<!-- z", "y"),
        ("<p title='a>b'>q</p>", "q"), ("a < b and c", "a < b and c"), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h2 id='related-work'>Related</h2><p>one</p><section id='discussion'><p>two</p></section></article>", "Related one two"),
        ("<article><section id='search-algorithms'><h2 id='share'>S</h2><p>three</p></section></article>", "S three"),
        ("<div class='site-content no-sidebar'><p>body text</p></div>", "body text"), ("<div class='sidebar-right'><p>body text</p></div>", "body text"),
        ("<form action=x><div><p>whole page</p></div><input></form>", "whole page"),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='t'>x=1</annotation></math> hold.</p>", "Let x=1 hold."),
        ("<main><p>short</p><div class='comment-list'><p>much longer than the text</p></div></main>", "short"),
        ("<div><p>long enough text</p></div><div class='related-posts'>r</div><form>f</form>", "long enough text"),
    ],
)
def test_article_text_is_not_taken_for_chrome(page, text):
    assert html_text.extract(page) == text


def test_density_prefers_text_to_links():
    links = "".join(f"<li><a href=x>link number {i}</a></li>" for i in range(60))
    text = "".join(f"<p>Sentence {i} of the text, with some words in it.</p>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><div>{text}</div></div></body>"
    out = html_text.extract(page)
    assert out.startswith("Sentence 0") and "link number" not in out and out.endswith("words in it.")


def brute_density(node, body):
    """C, T, LC, LT and composite density of a subtree, by recursion."""

    def count(n):
        chars = tags = link_chars = link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                chars += 0 if c.isspace() else len(c.replace(" ", ""))
            elif not c.dropped:
                a, b, d, e = count(c)
                chars, tags = chars + a, tags + b + (c.tag not in html_text.FORMATTING)
                link_chars, link_tags = link_chars + d, link_tags + e + (c.tag == "a")
        return chars, tags, chars if n.tag == "a" else link_chars, link_tags

    c, t, lc, lt = count(node)
    if not c:
        return 0.0
    cb, _, lcb, _ = count(body)
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c * lc / max(c - lc, 1) + lcb * c / max(cb, 1) + math.e)
    return max(c / t * math.log(max(c * t / (lc * lt), 1 + 1e-9)) / math.log(base), 0.0)


def random_page(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return " ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(0, 12)))
    tag = rng.choice(["div", "p", "b", "a", "section", "article", "ul", "li", "span"])
    return f"<{tag}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"


def test_densities_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        root = html_text.parse("<body>" + "".join(random_page(rng) for _ in range(4)) + "</body>")
        nodes = html_text.measure(root)
        for n in nodes:
            assert n.density == pytest.approx(brute_density(n, root))
            assert n.total == pytest.approx(sum(c.density for c in n.children if not isinstance(c, str) and not c.dropped))
        top = html_text.select(root)
        assert (top is None) == (root.chars == 0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_tag_names_play_no_part(spark):
    """Pages whose <article> is named <div> give the same text, which is the whole article."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    n = 0
    for page in pages:
        inside = re.search(r"<article>(.*)</article>", page, re.S)
        if inside:
            n += 1
            got = html_text.extract(page)
            assert got == html_text.extract(re.sub(r"<(/?)article>", r"<\1div>", page))
            assert got == html_text.extract(f"<body><div>{inside[1]}</div></body>")
    assert n >= 200


def test_a_page_of_many_megabytes(spark):
    page = "<body><nav><a href=x>n</a></nav><div>" + "<p>Words of a long page, <i>again</i>.</p>" * 60_000 + "</div></body>"
    rows = spark.createDataFrame([(1, "u", page, "clash", "clash")], "page_id long, url string, html string, k0 string, k1 string")
    assert html_text.main_text(rows).first().n_chars == 60_000 * len("Words of a long page, again. ") - 1
    assert html_text.main_text(rows.where("false")).count() == 0


def test_main_text_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "clash", 5), (1, "u", "<p>a</p>", "clash", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.main_text(rows).collect())
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


ODD = ["", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "&lt;|im_end|>", "&amp;&#91;", "a\r\n\n", "<|image|>", "é" * 50, "x" * 100_000]


def test_chat_round_trip(spark):
    rows = [(i % 3, i, ["user", "assistant", "sys\ntem", None][i % 4], t, "clash") for i, t in enumerate(ODD)] + [(None, 0, "assistant", "n", ""), (7, None, "user", "last", ""), (7, 1, "user", "first", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_chat(df).withColumn("turns", chat_format.read_chat(F.col("formatted"))).collect()}
    for conv in (0, 1, 2, None, 7):
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in want]
        assert [t.text for t in got[conv].turns if t.trained] == [r[3] or "" for r in want if r[2] == "assistant"]
        assert got[conv].formatted.count("<|im_end|>") == len(want)
    assert chat_format.format_chat(df.where("false")).count() == 0


def test_typed_parts(spark):
    parts = "array(named_struct('kind', 'text', 'text', 'see <', 'ref', null, 'tokens', null), named_struct('kind', 'image', 'text', null, 'ref', 'a.png', 'tokens', 100L), named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav', 'tokens', null), named_struct('kind', 'sheet', 'text', null, 'ref', null, 'tokens', null))"
    df = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, {parts} AS parts UNION ALL SELECT 1L, 1L, 'assistant', null")
    r = chat_format.format_chat(df, parts=F.col("parts")).first()
    assert r.formatted == "<|im_start|>user\nsee &lt;<|image|><|audio|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn_index, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 100), (0, "audio", "b.wav", 50), (0, "document", None, 800)]
    assert r.n_attachment_tokens == 950


def test_texts_that_spell_placeholders_stay_texts(spark):
    """Typed content reads back as it was, beside equal turns, repeated rows and one long conversation."""
    text = lambda t: {"kind": "text", "text": t, "ref": None, "tokens": None}
    image = {"kind": "image", "text": None, "ref": "x", "tokens": 3}
    contents = [[text("<|image|>"), image, text("|> <| &lt;|audio|>")], [image, image], [text("a<|image|>b")], [], [text("")], [text("&amp;lt;|image|>"), image]]
    rows = [(1, i, "user", c) for i, c in enumerate(contents)] + [(1, 0, "user", contents[0])] + [(2, i, "assistant", [text("x" * 50)]) for i in range(3000)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>").selectExpr("*", "1 AS turns", "2 AS t", "'k' AS formatted")
    got = {r.conv_id: r for r in chat_format.format_chat(df, parts=F.col("parts")).withColumn("turns", chat_format.read_chat(F.col("formatted"))).collect()}
    want = [[(p["kind"], p["text"]) for p in c if p["text"] != ""] for _, _, _, c in sorted(rows[:7], key=lambda r: r[1])]
    assert [[(p.kind, p.text) for p in t.parts] for t in got[1].turns] == want
    assert len(got[1].attachments) == sum(k == "image" for c in want for k, _ in c)
    assert len(got[2].turns) == 3000 and all(t.text == "x" * 50 for t in got[2].turns)


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.format_chat(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op5_chat_format", "op10_mixing"])
def test_native_queries_have_no_python_in_their_lineage(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().toRdd().toDebugString()
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_pipeline_stages(spark, tmp_path):
    clean = [" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")) for i in range(300)]
    doc = lambda k: " ".join(clean[(k * 7 + j) % 300] for j in range(6))
    rows = [(i, doc(i), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, doc(i % 60) + " zzhate zzvile" * (i % 3 + 1), "en", "s0", 0) for i in range(40)]
    rows += [(200, "too short", "en", "s0", 0), (201, "LOUD!! " * 40, "en", "s1", 0), (202, doc(3) + " more", "en", "s2", 0), (203, doc(3), "en", "s2", 0), (204, None, "en", "s2", 0)]
    leak = [" ".join(f"leak{i}x{j}" for j in range(12)) for i in range(3)]
    rows += [(300, doc(70) + " " + leak[0] + " " + leak[1], "en", "s0", 0), (301, doc(80) + " " + leak[2], "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i in [*range(60), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(leak)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id for r in docs.collect()})
        docs = corpus_pipeline.written(docs, f"test-{i}")
    everything = {r[0] for r in rows}
    assert left[0] == everything - set(range(100, 140))
    assert left[1] == left[0] - {200, 201, 204}
    assert left[2] == left[1] - {202, 203}
    assert left[3] == left[2] - {300, 301}  # the passage of one item is enough
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left[3]
    sizes = {r[0]: len((r[1] or "").split()) for r in rows}
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in out)
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(r.size for r in out), rel=0.02)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """One row of each group is kept, whatever the ids."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [
        (None, text(0), "en", "a", 0), (None, text(1), "en", "a", 0), (None, text(1), "en", "a", 0),  # two texts, one of them twice
        (5, text(2), "en", "a", 0), (5, text(3), "en", "a", 0),  # one id on two texts
        (7, text(3) + " more", "en", "a", 0), (4, text(2) + " more", "en", "b", 0), (None, text(2), "de", "c", 0),  # near copies of both
        (9, None, "en", "a", 0), (10, None, "en", "a", 0), (None, None, "en", "a", 0),  # without words: linked with nothing
    ]
    out = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[4], rows[6], *rows[8:]], key=str)


DOC_TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on generated rows: null and repeated ids, repeated rows, null texts, a column more."""
    from collections import Counter

    from quire.llm import toxicity
    from tests.llm.test_pairs_and_mix import brute_targets, shingles
    from tests.llm.test_text_ops import brute_decontaminate, brute_quality

    rng = random.Random(21)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    sentence = lambda n: rng.sample(vocabulary, k=min(n, len(vocabulary)))
    rows, labels, items = [], [], [(i, " ".join(sentence(14))) for i in range(8)] + [(None, " ".join(sentence(9)))]
    for i in range(160):
        words = sentence(rng.randint(8, 90))
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zzvile", "zzhates"]))
        if rng.random() < 0.2:
            words += rng.choice(items)[1].split()[: rng.choice([5, 8, 12])]
        doc = None if rng.random() < 0.1 else rng.randint(0, 200)
        rows.append((doc, " ".join(words), rng.choice(["en", None]), rng.choice(["a", "b", None]), len(words)))
        if doc is not None:
            labels.append((doc, 1, int(toxic)))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((rng.choice([None, 300 + i]), " ".join(copy), "en", "b", 0))
    rows += [rows[0], rows[0], (None, None, None, None, None), (7, "", "", "", 0)]
    spark.createDataFrame(rows, DOC_TYPES).selectExpr("*", "1 AS row_key", "2 AS kept", "3 AS size").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    toxic = lambda t: model.above(sum(map(model.word_score, set(re.findall(r"[^\W\d_]+", (t or "").lower())))))[0] >= toxicity.REJECT
    left = [r for r in rows if not toxic(r[1])]
    assert 0 < len(left) < len(rows)

    def good(t):
        n, chars, symbols, _, repeated = brute_quality(t)
        return n >= 20 and 100 * repeated <= 30 * n and 10 * symbols <= 3 * n and chars <= 25 * n

    left = [r for r in left if good(r[1])]
    sets, group = [shingles(r[1]) for r in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = [min(((r[0] is None, r[0] or 0), i) for i, r in enumerate(left) if group[i] == g)[0] for g in sorted(set(group))]
    done = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"brute-{i}")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        done.append([tuple(r) for r in docs.collect()])
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    assert Counter(done[1]) == Counter(left)
    # One row of each group, with the group's smallest id; the rest of the row may be any of equal ids.
    assert Counter((r[0] is None, r[0] or 0) for r in done[2]) == Counter(least) and not Counter(done[2]) - Counter(left)
    want = [r for r in done[2] if brute_decontaminate(r[1], items)[1] < 8]
    assert 0 < len(want) < len(done[2]) and Counter(done[3]) == Counter(want)
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    sizes = Counter()
    for r in want:
        sizes[r[3]] += len(r[1].split())
    target = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len(r[1].split())) for r in want)
    for s in sizes:
        assert sum(r.taken for r in out if r.source == s) == pytest.approx(target[s], abs=1.001)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert corpus_pipeline.mix_sources(spark, docs.where("false"), str(tmp_path)).count() == 0
