"""Preamble and line passes, the order of the project's passes, and figure widths in the source."""

import random

import pytest
from pyspark.sql import functions as F

from quire.latex import figures, preamble, project

HEAD = "\\documentclass[10pt,letterpaper]{article}\n\\usepackage{lmodern}\n\\usepackage[margin=1in]{geometry}"


def test_fonts():
    t1 = "\\documentclass{book}\n\\usepackage[T1]{fontenc}\n\\usepackage{xcolor}"
    assert preamble.font_package(t1, "times") == t1.replace("\n\\usepackage{xcolor}", "\n\\usepackage{newtxtext,newtxmath}\n\\usepackage{xcolor}")
    assert preamble.font_package(HEAD, "palatino", "OT1").split("\n")[1] == "\\usepackage{newpxtext,newpxmath}"
    assert "lmodern" not in preamble.font_package(HEAD, "computerModern")
    assert preamble.font_package("text", "latinModern", "OT1") == "text\n\\usepackage{lmodern}"
    assert preamble.font_package(HEAD, "unknown") == HEAD and "lmodern" in preamble.font_package(HEAD, "helvetica")
    assert preamble.font_encoding(t1, "OT1") == "\\documentclass{book}\n\\usepackage{xcolor}"
    for family in preamble.FONT_PACKAGES:
        once = preamble.font_package(HEAD, family)
        assert preamble.font_package(once, family) == once


def test_title_sizes():
    page = "a\n\\begin{titlepage}\n{\\Large River Atlas}\n{\\tiny small print here}\n{\\Huge ab}\n{\\small Unknown words}\n\\end{titlepage}\n{\\Large River Atlas}"
    out = preamble.title_sizes(page, [("River Atlas of the North", 24.0), ("SMALL PRINT HERE", 40.3), ("x", 5.0)])
    assert out == page.replace("{\\Large River Atlas}\n{\\tiny", "{\\Huge River Atlas}\n{\\fontsize{40.3}{48}\\selectfont", 1)
    assert preamble.title_sizes(out, [("River Atlas of the North", 24.0)]) == out
    assert preamble.title_sizes("no page", [("River", 9.0)]) == "no page"
    assert preamble.clean_for_matching("{\\bfseries\\Large A \\textcopyright{} B}\\\\") == "A © B"


def test_packages(spark):
    row = spark.range(1).select(preamble.wanted_packages(F.lit("\\begin{itemize} \\bm{x} \\begin{align*} \\mathbb{R}"), F.lit("\\usepackage{bm}\n\\usepackage{amssymb,x}")).alias("w")).first()
    assert row.w == ["enumitem", "amsmath"]
    assert spark.range(1).select(preamble.with_packages(F.lit("p"), F.array(F.lit("q")))).first()[0] == "p\n% Auto-detected packages\n\\usepackage{q}\n"
    docs = spark.createDataFrame([(1, "% \\input{no}\n\\input{plain}\nx \\input{head}"), (2, "\n" * 30 + "\\input{head}")], "doc int, source string")
    files = spark.createDataFrame([(1, "plain.tex", "x"), (1, "head.tex", "\\documentclass{a}"), (2, "head.tex", "\\documentclass{a}"), (1, "no.tex", "\\documentclass{a}")], "doc int, path string, source string")
    assert [tuple(r) for r in preamble.external_preamble(docs, files).collect()] == [(1, "head.tex")]


def test_line_breaks():
    full = "w" * 40
    source = f"{full}\\\\\nand more\n{full} \\\\\n\\section{{x}}\nshort\\\\\nnext\n\\begin{{tabular}}{{l}}\n{full}\\\\\n\\end{{tabular}}\n{full}\\dotfill 3\\\\\n\\\\"
    out, n = preamble.line_breaks(source, 40)
    assert n == 2 and out.startswith(f"{full} and more\n{full}\n\\section{{x}}\nshort\\\\\nnext\n")
    assert out.endswith(f"{full}\\\\\n\\end{{tabular}}\n{full}\\dotfill 3\\\\\n\\\\")
    assert preamble.line_breaks(out, 40) == (out, 0)


def test_manual_chapters():
    source = "a\n\\noindent{\\Large\\textbf{Chapter 4}}\n\\bigskip\n\n{\\centering\\noindent{\\LARGE\\textbf{Lakes}}\\par}\n\\vspace{2cm}\ntext\nsee Chapter 4\n\\textbf{Chapter 5}\n4.1 Ponds"
    assert preamble.manual_chapters(source) == "a\n\\chapter{Lakes}\ntext\nsee Chapter 4\n\\textbf{Chapter 5}\n4.1 Ponds"
    far = "\\textbf{Chapter 2}" + "\n" * 9 + "Too far"
    assert preamble.manual_chapters(far) == far
    for line, title in (("{\\huge\\bfseries  Seas}", "Seas"), ("\\bfseries Hills", "Hills"), ("Plain", "Plain"), ("\\textbf{Woods}", "Woods")):
        assert preamble.chapter_title(line) == title


def test_project_order_and_idempotence():
    assert [n for n, _ in project.STEPS].index("split_lists") < [n for n, _ in project.STEPS].index("page_counters") < [n for n, _ in project.STEPS].index("page_duplicates")
    main = (
        HEAD + "\n\\begin{document}\n%% === Page 4 ===\n\\textbf{Chapter 1}\n\\textbf{Rivers}\ncosts $5\nsame words here\n%% === Page 5 ===\nsame words here\n$\\argmax x$\n"
        "\\begin{itemize}\n\\item a\n\\end{itemize}\n%% === Page 6 ===\n\\item b\n"
    )
    profile = project.Profile(paper="a4paper", family="times", geometry="left=1in", symbols=[("words", "terms")])
    out, head, counts, notes = project.normalize_project(main, None, profile)
    done = {k for k, n in counts.items() if n}
    assert {"book_class", "paper_size", "font_package", "font_size", "margins", "operators", "manual_chapters", "currency", "end_document", "split_lists", "page_counters", "opening", "symbols", "page_duplicates"} - done == {"book_class", "opening"}
    assert head is None and out.count("same terms here") == 1 and "\\setcounter{page}{4}" in out and "letterpaper" not in out
    again = project.normalize_project(out, None, profile)
    third = project.normalize_project(again[0], None, profile)
    assert third[0] == again[0] and again[2]["book_class"] == 1  # the chapter was found by a later pass than the class
    body = main[main.index("\\begin{document}") :]
    text, head, counts, _ = project.normalize_project(body + "\\begin{figure}", HEAD, profile)
    assert counts["packages"] == 1 and "xcolor" in head and "\\DeclareMathOperator{\\argmax}" in head and "DeclareMath" not in text


def test_passes_leave_their_output_alone():
    rng = random.Random(5)
    parts = [
        "\\textbf{Chapter 3}", "\\textbf{Lakes}", "\\bigskip", "", "w" * 50 + "\\\\", "and so on", "\\begin{tabular}", "\\end{tabular}", "%% === Page 2 ===", "%% === Page 3 ===",
        "\\chapter{Lakes}", "costs $5 or $x$", "\\item a", "\\begin{itemize}", "\\end{itemize}", "\\documentclass{article}", "\\usepackage{lmodern}", "\\begin{document}", "same line",
    ]
    profile = project.Profile(paper="a4paper", family="computerModern")
    for _ in range(400):
        source = "\n".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert preamble.manual_chapters(preamble.manual_chapters(source)) == preamble.manual_chapters(source)
        once = preamble.font_package(source, "computerModern")
        assert preamble.font_package(once, "computerModern") == once
        state = source
        for _ in range(4):
            state = project.normalize_project(state, None, profile)[0]
        assert project.normalize_project(state, None, profile)[0] == state, source


@pytest.mark.parametrize(("call", "want"), [("\\includegraphics{figures/m}", "[W]{"), ("\\includegraphics[angle=5]{figures/m}", "[W,angle=5]{"), ("\\includegraphics[]{figures/m}", "[W]{"), ("\\includegraphics*{figures/m}", "*[W]{")])
def test_widths_in_the_source(spark, call, want):
    docs = spark.createDataFrame([("d", f"%% === Page 2 ===\n{call}\nend", 7), ("e", "none", 8)], "doc string, source string, other int")
    figs = spark.createDataFrame([("d", 2, "m", [0.0, 0.0, 0.5, 0.5])], "doc string, page int, id string, bbox array<double>")
    pages = spark.createDataFrame([("d", 2, 400.0)], "doc string, page int, width double")
    files = spark.createDataFrame([("d", "figures/m.png")], "doc string, path string")
    got = {r.doc: r for r in figures.with_widths(docs, figs, pages, files).collect()}
    width = "width=\\ifdim\\linewidth<200bp \\linewidth\\else 200bp\\fi"
    assert want.replace("W", width) in got["d"].source and got["d"].source.endswith("\nend") and got["d"].other == 7
    assert [(n.line, n.kind) for n in got["d"].outcomes] == [(2, "widthApplied")] and got["e"].source == "none" and got["e"].outcomes == []
    again = figures.with_widths(docs.sparkSession.createDataFrame([("d", got["d"].source, 7)], "doc string, source string, other int"), figs, pages, files).first()
    assert again.source == got["d"].source and again.outcomes[0].kind == "explicitSizePreserved"
