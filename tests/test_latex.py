"""Lexer and rewrite passes: cases by hand, and properties on generated documents."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.latex import passes as P
from quire.latex.lexer import Scan

M = "%% === Page {} ===".format


def active_words(source):
    scan = Scan(source)
    return [t.name for t in scan.tokens if t.kind == "word" and scan.active(t)]


def test_comments_and_verbatim_are_not_code():
    assert active_words(r"\a % \b" + "\n" + r"\verb|\c| \d \begin{verbatim}\e" + "\n" + r"\end{verbatim} \f") == ["a", "verb", "d", "begin", "end", "f"]
    assert active_words(r"\% \x") == ["x"]
    assert active_words("\\begin% c\n{verbatim}\\x\n\\end{verbatim}\\y") == ["begin", "end", "y"]
    assert active_words("\\begin{Verbatim}\\x\n\\end{Verbatim} \\lost\n\\y") == ["begin", "end", "y"]
    assert active_words("\\begin{comment}\n\\x \\end{comment}\n\\end{comment}\n\\y") == ["begin", "end", "y"]


def test_verb_delimiters():
    for source, inside in ((r"\verb*+a+b", "*+a+"), (r"\verb *x*b", " *x*"), (r"\verb+open", "+open"), ("\\verb\nwhole line\nb", "\nwhole line")):
        assert [source[t.start : t.end] for t in Scan(source).tokens if t.kind == "verbatim"] == [inside]


def test_definitions_are_not_executed():
    assert active_words(r"\newcommand{\x}[1][d]{\chapter{#1}} \y") == ["y"]
    assert active_words(r"\def\x#1{\chapter} \y") == ["y"]
    assert active_words(r"\let\x=\chapter \y") == ["y"]
    assert active_words("\\let\\x\n\n\\chapter") == ["chapter"]
    assert active_words(r"\newenvironment{e}{\begin{x}}{\end{x}} \y") == ["y"]
    assert active_words(r"\NewDocumentCommand{\x}{m}{\chapter} \y") == ["y"]


def test_body_and_markers():
    source = f"{M(1)}\n\\begin{{document}}\n{M(2)}\n% {M(3)}\n\\begin{{verbatim}}\n{M(4)}\n\\end{{verbatim}}\n{M(5)} x\n\\end{{document}}\n{M(6)}"
    assert Scan(source).marker_lines == [(0, 1, False), (2, 2, True), (9, 6, False)]


def test_line_questions():
    scan = Scan("word \\emph\n{1}\n\\hline\n& a\nplain % c\n\\\\x")
    assert [scan.looks_like_prose(i) for i in range(6)] == [True, False, False, False, True, False]
    assert [scan.ends_with_control(i) for i in range(6)] == [True, False, True, False, False, False]
    assert Scan("a $x\ny$ b\n").math_lines() == [False, True, False]
    assert Scan("$$x\n$$\n\\[\ny\\]").math_lines() == [False, True, False, True]
    assert Scan("\\]").math_lines() is None
    assert Scan("\\begin{tabular}{c}\na\\end{tabular}\n").alignment_lines() == [False, True, False]


def test_balanced_lines():
    ok = lambda s: Scan(s).balanced(list(range(s.count("\n") + 1)))
    assert ok("a {b} $c$ $$d$$ \\begin{x}y\\end{x} \\left( \\right)")
    for bad in ("{", "}", "\\end{x}", "\\begin{x}", "$a", "\\[", "\\ifx", "\\fi", "\\begin{a}\\end{b}"):
        assert not ok(bad), bad


def test_page_duplicates():
    source = f"one\ntail a\ntail b\n{M(2)}\ntail a\n\n%% note\ntail b\nhead\n{M(3)}\nhead\nend"
    assert P.page_duplicates(source) == f"one\ntail a\ntail b\n{M(2)}\n\n%% note\nhead\n{M(3)}\nend"
    for kept in (f"\\begin{{itemize}}\n\\end{{itemize}}\n{M(2)}\n\\end{{itemize}}", f"$x\nabc\n{M(2)}\nabc\n$", f"\\frac\nx\n{M(2)}\nx", f"\\begin{{verbatim}}\na\n{M(2)}\na\n\\end{{verbatim}}", f"\\begin{{tabular}}{{c}}\nc\n{M(2)}\nc\n\\end{{tabular}}"):
        assert P.page_duplicates(kept) == kept


def test_environments():
    assert P.environment_issues("\\begin{a}\n\\begin{b}\n\\end{a}\n\\end{x}\n\\end{y}") == [("mismatch", "b", 2), ("mismatch", "a", 1), ("extraClose", "y", 5)]
    assert P.repair_environments("\\end{x}\na\n\\begin{b}\n\\begin{c}") == "a\n\\begin{b}\n\\begin{c}\n\\end{c}\n\\end{b}"


def test_logs():
    log = "! Undefined control sequence.\n<read>\nl.7 \\zz\n! Missing } inserted.\na\nb\nc\nd\nl.9 late\nx/b.tex:31: Missing $ inserted.\nb.tex:32: a remark\n! LaTeX Error: \\begin{q} on input line 3 ended by \\end{r}."
    assert P.log_errors(log) == [
        ("undefined_command", 7, "Undefined control sequence."), ("missing_brace", None, "Missing } inserted."), ("missing_math", 31, "Missing $ inserted."),
        ("environment", None, "LaTeX Error: \\begin{q} on input line 3 ended by \\end{r}."),
    ]
    assert P.error_category("Emergency stop.") == "other" and P.error_category("Environment q undefined") == "environment"
    assert P.log_errors("fine\n") == []


def test_small_passes():
    assert P.book_class("\\documentclass[11pt]{article}", True) == "\\documentclass[11pt]{book}"
    assert P.paper_size("a4paper,x", "letterpaper") == "letterpaper,x"
    assert P.font_size("\\documentclass[11pt,a4paper]{book}", 10.0) == "\\documentclass[10pt,a4paper]{book}"
    assert P.font_size("\\documentclass[a4paper]{book}", 12.0) == "\\documentclass[12pt,a4paper]{book}"
    assert P.margins("\\usepackage[a]{geometry}", "left=1in") == "\\usepackage[left=1in]{geometry}"
    assert P.missing_operators("$\\E x \\var y$", "\\DeclareMathOperator{\\var}{var}") == ["E"]
    assert P.missing_packages("\\includegraphics{x}", "\\usepackage[o]{graphicx, xcolor}") == []
    assert P.duplicate_chapters("\\chapter{A}\nx\n\\chapter{A}\n\\chapter{B}") == "x\n\\chapter{A}\n\\chapter{B}"
    assert P.verbatim_in_fbox("\\fbox{%\n\\begin{minipage}\n\\begin{verbatim}\n\\end{verbatim}\n\\end{minipage}%\n}") == "\\begin{minipage}\n\\begin{verbatim}\n\\end{verbatim}\n\\end{minipage}"
    assert P.equation_splits("\\begin{equation}\na\n\\]\n\\[\nb\n\\end{equation}\n\\]\n\\[") == "\\begin{equation}\na\nb\n\\end{equation}\n\\]\n\\["
    assert P.tags_after_aligned("\\begin{aligned}\na\n\\tag{1}\n\\end{aligned}\n\\]") == "\\begin{aligned}\na\n\\end{aligned}\n\\tag{1}\n\\]"
    assert P.misescaped_dollars("\\$5 x$ and \\$7") == ("$5 x$ and \\$7", 1)
    assert P.currency("costs $15 and \\$3 and \\\\$4\n$5x$") == ("costs \\$15 and \\$3 and \\\\\\$4\n$5x$", 2)
    assert P.visible_length("\\textbf{ab \\emph{c}} d\\\\") >= 6


FRAGMENTS = ["word", "\\emph{x}", "{1}", "$a$", "\\begin{itemize}", "\\end{itemize}", "%% note", "% c", "", "\\chapter{T}", "\\[", "\\]", "costs $5", "\\$5 x$", "\\verb|$5|", "\\begin{verbatim}", "\\end{verbatim}", "\\frac", "tail a", "tail b", M(2), M(3), "\\let\\x\\y", "\\newcommand{\\z}{q}", "\\tag{1}"]
documents = st.lists(st.sampled_from(FRAGMENTS), max_size=18).flatmap(lambda x: st.sampled_from(["\n", "\r\n"]).map(lambda e: e.join(x)))


@settings(max_examples=300, deadline=None)
@given(documents)
def test_passes_leave_their_own_output_alone(source):
    for step in (P.page_duplicates, P.strip_markers, P.duplicate_chapters, P.equation_splits, P.tags_after_aligned, lambda s: P.currency(s)[0], P.repair_environments):
        once = step(source)
        assert step(once) == once


@settings(max_examples=300, deadline=None)
@given(documents)
def test_page_duplicates_only_remove_planned_lines(source):
    planned, deleted = P.duplicate_plan(source)
    assert deleted <= planned and deleted <= P.duplicate_plan(source, vetoes=False)[1]
    out = iter(source.split("\n"))
    assert all(line in out for line in P.page_duplicates(source).split("\n"))
    assert Scan(P.page_duplicates(source)).verbatim_texts == Scan(source).verbatim_texts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\{}[]$%&verb\n a*|", max_size=60))
def test_tokens_cover_the_source(source):
    scan = Scan(source)
    assert "".join(source[t.start : t.end] for t in scan.tokens) == source
