"""Column functions and operators on cases by hand."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import compare, joins, layout, sequence, status, votes


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("The ﬁrst\u00a0x−y × !! 2\u200b3 \u2028 End"))) == ["the", "first", "x-y", "x", "23", "end"]
    assert one(spark, T.set_coverage(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, T.char_ngrams(F.lit("a"))) == []
    assert one(spark, T.char_ngrams(F.lit("abc"))) == ["ab", "bc"]
    assert one(spark, T.truncated(F.lit("x" * 50), 5, 5, 0, "|")) == "xxxxx|xxxxx"
    assert one(spark, T.slug(F.lit(" --A b/C! "), "f")) == "a-b-c" and one(spark, T.slug(F.lit("??"), "f")) == "f"
    assert one(spark, T.family_key(F.lit("ABCDEF+CMR10-Bold"))) == "CMR" and one(spark, T.family_key(F.lit("12"))) == "12"
    assert one(spark, T.escape_currency(F.lit("a $5 \\$5 \\\\$5\n$5"))) == "a \\$5 \\$5 \\\\\\$5\n$5"


@pytest.mark.parametrize(
    ("label", "want"),
    [("7", ("arabic", 7)), ("0308", ("arabic", 308)), ("xix", ("roman", 19)), ("CDXLIV", ("Roman", 444)), ("mdcclxxvi", ("roman", 1776)), ("m" * 50, ("roman", 50_000)), (str(2**31 - 1), ("arabic", 2**31 - 1))]
    + [(x, None) for x in ("", "vx", "xXi", "p7", "q", "7b", "xi ", "७", "8" * 30, "m" * 65, str(2**31))],
)
def test_page_labels(spark, label, want):
    got = one(spark, L.parse_label(F.lit(label)))
    assert (tuple(got) if got else None) == want


def test_geometry(spark):
    a4 = lambda w, h: one(spark, G.a4_class(F.lit(w), F.lit(h)))
    w, h = 210 / G.MM_PER_PT, 297 / G.MM_PER_PT
    assert [a4(w, h), a4(595.28, 841.89), a4(596.0, 843.0), a4(612.0, 792.0), a4(w + 1.4996, h), a4(w + 1.5003, h), a4(h, w)] == ["exactA4", "exactA4", "nearA4", "other", "nearA4", "other", "exactA4"]
    assert one(spark, G.paper_class(F.lit(612.0), F.lit(792.0))) == "letterpaper"
    box = lambda *b: one(spark, G.valid_bbox(F.array(*map(F.lit, b)).cast("array<double>")))
    assert box(0.12, 0.08, 0.68, 0.31) and not box(0.5, 0.5, 0.6, 0.1) and not box(0.1, 0.1, 0.2) and not box(0.0, 0.0, 0.0, 1.0) and not box(float("nan"), 0.0, 0.1, 0.1)
    assert [one(spark, G.swaps_sides(F.lit(r))) for r in (0, 90, 180, 270, -90, 450)] == [False, True, False, True, True, True]
    assert L.figure_file and one(spark, L.figure_file(F.lit(12), F.lit("Fig01"))) == "p012-fig01"
    assert one(spark, L.figure_file(F.lit(12), F.lit("p012-x"))) == "p012-x" and one(spark, L.figure_file(F.lit(1), F.lit("a/b"))) is None


def test_similarity():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    import random

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in (0, 1))
        assert compare.lcs_length(a, b) == plain(a, b)
    assert compare.chunked_similarity([], []) == 1 and compare.chunked_similarity(["a"], []) == 0
    words = [str(i) for i in range(1000)]
    assert compare.chunked_similarity(words, words) == 1.0


def test_toc():
    assert layout.parse_toc(["1 Introduction ..... 1", "1.1 Aims ... 2", "Exercises 9", "2 Linear Models 9", "A Matrix Algebra ... 20", "2 Again Models .... 30"]) == [("1", "Introduction", 1), ("2", "Linear Models", 9), ("A", "Matrix Algebra", 20)]
    assert layout.parse_toc(["1", "First Steps", "3", "2", "More Steps .... 8", "3", "no capital"]) == [("1", "First Steps", 3), ("2", "More Steps", 8)]


def test_regions(spark):
    kind = lambda t, x, y, w, m=0.0: one(spark, layout.classify_region(F.lit(t), F.lit(x), F.lit(y), F.lit(w), F.lit(30.0), F.lit(600.0), F.lit(m)))
    assert kind("CHAPTER 1. X " * 9, 0.0, 10.0, 500.0) == "header"
    assert kind("1.2 Models", 0.0, 100.0, 500.0) == "heading"
    assert kind("x = α", 250.0, 100.0, 100.0) == "equation"
    assert kind("long", 50.0, 100.0, 500.0, 0.9) == "equation"
    assert kind("• a\n• b", 0.0, 100.0, 500.0) == "list"
    assert kind("text", 0.0, 100.0, 500.0) == "text"
    block = lambda t, y=500.0, n=1: one(spark, layout.classify_block(F.lit(t), F.lit(y), F.lit(800.0), F.lit(n)))
    assert [block("Figure 2 x"), block("Lemma 1"), block("Proof."), block("note", 10.0), block("a = b + c"), block("text", 500.0, 9)] == ["caption", "theorem", "proof", "footnote", "equation", "text"]


def test_strip_fold(spark):
    rows = [("d", 0.0, 14.0, 50.0, 550.0, "a"), ("d", 14.0, 14.0, 50.0, 540.0, "b"), ("d", 28.0, 14.0, 250.0, 350.0, "eq"), ("d", 42.0, 14.0, 50.0, 550.0, "c"), ("d", 90.0, 14.0, 50.0, 550.0, "far")]
    df = spark.createDataFrame(rows, "k string, y double, height double, x0 double, x1 double, text string").withColumn("page_width", F.lit(600.0))
    got = [(r.text, r.y, r.height) for r in layout.strip_clusters(df, ["k"]).orderBy("block").collect()]
    assert got == [("a\nb", 0.0, 28.0), ("eq", 28.0, 14.0), ("c", 42.0, 14.0), ("far", 90.0, 14.0)]


def test_font_votes(spark):
    counts = spark.createDataFrame([("a", "ABCDEF+CMR10", 5), ("a", "CMMI10", 50), ("a", "Arial", 1), ("b", "Times-Roman", 3), ("c", "SFRM1000", 3), ("c", "CMR10", 2)], "doc string, font string, n long")
    assert {r.doc: r.format for r in votes.source_from_fonts(counts, ["doc"]).collect()} == {"a": "latex", "b": "unknown", "c": "latex"}
    assert {r.doc: r.encoding for r in votes.font_encoding(counts, ["doc"]).collect()} == {"a": "OT1", "b": "T1", "c": "T1"}
    family = counts.select("font", votes.font_family(F.col("font")).alias("f")).collect()
    assert {r.font: r.f for r in family} == {"ABCDEF+CMR10": "computerModern", "CMMI10": None, "Arial": "helvetica", "Times-Roman": "times", "SFRM1000": "computerModern", "CMR10": "computerModern"}
    said = lambda c, p: tuple(one(spark, votes.source_from_metadata(F.lit(c), F.lit(p))))
    assert said("TeX", "pdfTeX-1.40") == ("latex", "unknown", 0.7) and said(None, "xdvipdfmx") == ("latex", "dvipdfm", 0.9)
    assert said("Plain text", "Microsoft Word") == ("word", "unknown", 0.9) and said(None, None) == ("unknown", "unknown", 0.0)


def test_runs_and_batches(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4, 7, 9, 10)], "k int, n long")
    assert sequence.run_text(sequence.islands(df, ["k"], "n"), ["k"]).first().ranges == "1-4, 7, 9-10"
    assert [r.batch for r in sequence.batches(df, ["k"], ["n"], 3).orderBy("n").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_status(spark):
    log = spark.createDataFrame([(1, 1, 1, "segmented"), (1, 2, 2, "transcribing"), (2, 1, 1, "segmented"), (2, 1, 2, "transcribed"), (3, 1, 1, "failed")], "block_id int, ts int, seq int, status string")
    now = status.current(log)
    assert {r.block_id: r.status for r in now.collect()} == {1: "transcribing", 2: "transcribed", 3: "failed"}
    assert {r.block_id: r.status for r in status.recovered(now).collect()}[1] == "queued"
    assert [r.block_id for r in status.runnable(status.recovered(now), ["block_id"]).collect()] == [1, 3]
    assert {(r.block_id, r.seq): r.allowed for r in status.transitions(log).collect()}[(2, 2)] is False


def test_ranks_of_large_keys_need_no_task_with_a_whole_key(spark, monkeypatch):
    """Places within few keys, null among them, come from ranges: no window runs over the rows themselves."""
    monkeypatch.setattr(sequence, "RANGE_ROWS", 64, raising=False)
    rows = [(None if i % 3 == 0 else "ab"[i % 2], (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    by = {k: sorted(v for x, v in rows if x == k) for k in (None, "a", "b")}
    out = sequence.stride(df, ["k"], ["v"], 20)
    assert "Window" not in out._jdf.queryExecution().toString()
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in spark.createDataFrame([(k, v) for k, vs in by.items() for v in vs[:: max(1, len(vs) // 20)]], "k string, v int").collect())
    half = df.where("v < 500").withColumnRenamed("v", "w")
    both = joins.zipped(df, half, [F.desc("v")], ["w"], ["k"])
    assert "Window" not in both._jdf.queryExecution().toString()
    want = [(k, i + 1, v, w) for k in "ab" for i, (v, w) in enumerate(zip(by[k][::-1], [w for w in by[k] if w < 500]))]
    assert sorted(tuple(r[c] for c in ("k", "pos", "v", "w")) for r in both.collect()) == sorted(want)
    assert sequence.stride(df.limit(0), ["k"], ["v"], 20).count() == 0
