"""Project files round trip; figures find their widths."""

import pytest
from pyspark.sql import functions as F

from quire.latex import figures
from quire.sources import project as P


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schemaVersion": 2, "projectName": "p", "projectRoot": "r", "pages": [{"number": 1, "width": 612.0, "label": "i"}, {"number": 1, "label": "x"}, {"number": 2}], "blocks": []}')
    df = P.read_manifest(spark, f"file://{tmp_path}/m.json")
    assert df.first().ocrResults == []
    assert [(r.page, r.label) for r in P.page_labels(df).collect()] == [(1, "i")]
    P.write_manifest(df, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"label":"i"' in text and "null" not in text
    assert P.read_manifest(spark, f"file://{tmp_path}/out").first() == df.first()


def test_responses(spark, tmp_path):
    good = '{"pages": [{"page": 31, "latex": "x", "figures": [{"id": "map-a", "bbox": [0.25, 0.5, 0.375, 0.125]}]}]}'
    for name, text in (("a.json", good), ("b.json", f"```json\n{good}\n```"), ("c.json", "garbage {"), ("d.txt", good)):
        (tmp_path / name).write_text(text)
    rows = {r.file: r.readable for r in P.read_responses(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.json": True, "b.json": True, "c.json": False}
    assert [(r.page, r.id, list(r.bbox)) for r in P.response_figures(P.read_responses(spark, f"file://{tmp_path}")).collect()] == [(31, "map-a", [0.25, 0.5, 0.375, 0.125])]


def test_page_files_and_accumulation(spark, tmp_path):
    for name, text in (("page-0001.tex", "one"), ("page-0002.tex", "%% === Page 2 ===\ntwo"), ("page-3.tex", "no"), ("page-0004.tex.bak", "no")):
        (tmp_path / name).write_text(text)
    pages = P.read_page_files(spark, f"file://{tmp_path}").withColumn("doc", F.lit("d"))
    wanted = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    assert P.accumulate(pages, wanted).first().source == "%% === Page 1 ===\none\n%% === Page 2 ===\ntwo"
    more = wanted.union(spark.createDataFrame([("d", 3)], "doc string, page int"))
    with pytest.raises(Exception, match="no source for page 3"):
        P.accumulate(pages, more).collect()
    assert {r.page: r.source for r in P.placeholders(more, pages.select("doc", "page", "source"), ["doc", "page"], "TODO").collect()}[3] == "TODO"


def test_ranges(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    n = F.lit(60)
    assert one(P.page_range(F.lit(10), F.lit(3), F.lit(99))) == list(range(3, 11)) and one(P.page_range(F.lit(0), F.lit(1), F.lit(2))) == []
    assert [tuple(r) for r in one(P.ranges_from_text(F.lit("1-24, 25-60"), n))] == [("chapter-01", "Pages 1-24", 1, 24), ("chapter-02", "Pages 25-60", 25, 60)]
    for bad in ("x", "9-3", "1-99", "1-2,,"):
        with pytest.raises(Exception, match="bad page range"):
            one(P.ranges_from_text(F.lit(bad), n))


def test_strategy_chain(spark):
    a = spark.createDataFrame([(1, "x")], "doc int, title string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "doc int, title string")
    assert sorted((r.doc, r.title, r.strategy) for r in P.chapters_or(("outline", a), ("toc", b)).collect()) == [(1, "x", "outline"), (2, "z", "toc")]


def test_transcriber_retries_once(spark):
    def fake(row):
        if row["page"] == 2:
            raise TimeoutError("slow")
        if row["page"] == 3:
            raise ValueError("bad")
        return f"tex {row['page']}"

    out = P.transcribe(spark.createDataFrame([(1,), (2,), (3,)], "page int"), fake)
    assert {r.page: (r.response, r.error) for r in out.collect()} == {1: ("tex 1", None), 2: (None, "timeout: slow"), 3: (None, "ValueError: bad")}


def test_figure_widths(spark):
    source = (
        "%% === Page 31 ===\n\\includegraphics{figures/p031-map-a.png}\n\\includegraphics[height=4cm]{figures/map-a}\n% \\includegraphics{no}\n\\includegraphics[angle=5]{figures/map-b}\n"
        "\\includegraphics{figures/none}\n\\includegraphics{figures/outside}\n\\includegraphics{figures/twice}\n\\newcommand{\\x}{\\includegraphics{figures/map-a}}"
    )
    docs = spark.createDataFrame([("d", source), ("e", "\\includegraphics{figures/map-a}"), ("f", "none")], "doc string, source string")
    calls = figures.graphics_calls(docs)
    boxes = [("map-a", [0.25, 0.5, 0.375, 0.125]), ("map-b", [0.0, 0.1, 0.4, 0.4]), ("outside", [0.3, 0.7, 0.2, 0.4]), ("twice", [0.1, 0.1, 0.3, 0.3]), ("twice", [0.1, 0.1, 0.6, 0.3])]
    figs = spark.createDataFrame([("d", 31, i, b) for i, b in boxes], "doc string, page int, id string, bbox array<double>")
    pages = spark.createDataFrame([("d", 31, 500.0)], "doc string, page int, width double")
    files = spark.createDataFrame([("d", "figures/p031-map-a.png")], "doc string, path string")
    got = {(r.doc, r.n): r for r in figures.figure_widths(calls, figs, pages, files).collect()}
    # The outcomes' names.
    want = ["widthApplied", "explicitSizePreserved", "missingImageFile", "noMatchingFigure", "invalidBoundingBox", "ambiguousFigure"]
    assert [got["d", i].outcome for i in range(6)] == want and got["e", 0].outcome == "noPageContext" and len(got) == 7
    assert (got["d", 0].fraction_text, got["d", 0].width_bp) == ("0.375", "187.5")
    assert figures.option_keys("width=3cm, a={x,y}, scale") == ["width", "a", "scale"]
    assert [figures.decimal_text(x, 6) for x in (0.5, 1e-9, -1.0, float("nan"), 612.0)] == ["0.5", None, None, None, "612"]
