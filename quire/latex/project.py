"""A project's sources normalized: every pass in its order, on the preamble or on the main text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.latex import figures, pages, passes, preamble

#: Class options and page widths in points by paper class; widths of other papers are a4's.
PAPER_OPTIONS = ("letterpaper", "a4paper", "legalpaper", "b5paper")
LETTER_WIDTH, OTHER_WIDTH, CHAR_WIDTH = 612.0, 595.28, 0.48


@dataclass
class Profile:
    """What is known of the original: its typography, title page, page labels, symbol table and figure widths."""

    paper: str | None = None
    family: str | None = None
    encoding: str = "T1"
    body_size: float = 11.0
    geometry: str | None = None
    left: float | None = None
    right: float | None = None
    title: list[tuple[str, float]] = field(default_factory=list)
    labels: dict[int, str] = field(default_factory=dict)
    symbols: list[tuple[str, str]] = field(default_factory=list)
    keep_markers: bool = True

    def chars_per_line(self) -> float:
        width = LETTER_WIDTH if self.paper == "letterpaper" else OTHER_WIDTH
        sides = ((1.0 if self.left is None else self.left) + (1.0 if self.right is None else self.right)) * 72.0
        return (width - sides) / (self.body_size * CHAR_WIDTH)


@dataclass
class State:
    main: str
    head: str | None
    profile: Profile
    notes: list[tuple[int, str, str]] = field(default_factory=list)


def _head(step: Callable[[str, State], str]) -> Callable[[State], int]:
    """A step on the external preamble, or on the main text where there is none."""

    def run(s: State) -> int:
        before = s.main if s.head is None else s.head
        after = step(before, s)
        if s.head is None:
            s.main = after
        else:
            s.head = after
        return int(after != before)

    return run


def _main(step: Callable[[str, State], str | tuple]) -> Callable[[State], int]:
    """A step on the main text; it may return a count or notes as well."""

    def run(s: State) -> int:
        got = step(s.main, s)
        text, more = got if isinstance(got, tuple) else (got, None)
        n = more if isinstance(more, int) else int(text != s.main)
        if isinstance(more, list):
            s.notes += more
        s.main = text
        return n

    return run


def _packages(s: State) -> int:
    """Only an external preamble gets packages."""
    if s.head is None:
        return 0
    names = passes.missing_packages(s.main, s.head)
    s.head = passes.add_packages(s.head, names)
    return len(names)


def _operators(text: str, s: State) -> str:
    return passes.add_operators(text, passes.missing_operators(s.main, text))


def _opening(text: str, s: State) -> tuple[str, list]:
    """The class may stand in the preamble while the chapters are in the main text."""
    if s.head is None:
        out, outcome = pages.open_any(text)
        return out, [(0, outcome, "")]
    if not any(n % 2 == 0 for n in pages.chapter_pages(text)):
        return text, [(0, "noEvenChapter", "")]
    s.head, outcome = pages.class_open_any(s.head)
    return text, [(0, outcome, "")]


#: The order is part of the contract: structural passes need the markers, which go last.
STEPS: tuple[tuple[str, Callable[[State], int]], ...] = (
    ("book_class", _head(lambda t, s: passes.book_class(t, "\\chapter{" in s.main))),
    ("paper_size", _head(lambda t, s: passes.paper_size(t, s.profile.paper) if s.profile.paper else t)),
    ("font_package", _head(lambda t, s: preamble.font_package(t, s.profile.family, s.profile.encoding) if s.profile.family else t)),
    ("font_size", _head(lambda t, s: passes.font_size(t, s.profile.body_size) if s.profile.family else t)),
    ("margins", _head(lambda t, s: passes.margins(t, s.profile.geometry) if s.profile.geometry else t)),
    ("title_sizes", _main(lambda t, s: preamble.title_sizes(t, s.profile.title))),
    ("operators", _head(_operators)),
    ("packages", _packages),
    ("line_breaks", _main(lambda t, s: preamble.line_breaks(t, s.profile.chars_per_line()) if s.profile.paper else t)),
    ("copyright", _main(lambda t, s: passes.copyright_signs(t))),
    ("manual_chapters", _main(lambda t, s: preamble.manual_chapters(t))),
    ("duplicate_chapters", _main(lambda t, s: passes.duplicate_chapters(t))),
    ("verbatim_in_fbox", _main(lambda t, s: passes.verbatim_in_fbox(t))),
    ("equation_splits", _main(lambda t, s: passes.equation_splits(t))),
    ("tags", _main(lambda t, s: passes.tags_after_aligned(t))),
    ("split_lists", _main(lambda t, s: pages.split_lists(t))),
    ("misescaped_dollars", _main(lambda t, s: passes.misescaped_dollars(t))),
    ("currency", _main(lambda t, s: passes.currency(t))),
    ("end_document", _main(lambda t, s: passes.end_document(t))),
    ("page_counters", _main(lambda t, s: pages.page_counters(t, s.profile.labels))),
    ("opening", _main(_opening)),
    ("symbols", _main(lambda t, s: passes.symbols(t, s.profile.symbols))),
    ("page_duplicates", _main(lambda t, s: passes.page_duplicates(t))),
    ("markers", _main(lambda t, s: t if s.profile.keep_markers else passes.strip_markers(t))),
)
#: Figure widths come between the openings and the symbols; they need the figures' table, so they are a join of their own.
WIDTHS_AFTER = "opening"


def run_steps(state: State, first: str | None = None, last: str | None = None) -> dict[str, int]:
    """The steps behind ``first`` up to ``last``, with what each did."""
    names = [n for n, _ in STEPS]
    a = names.index(first) + 1 if first else 0
    b = names.index(last) + 1 if last else len(STEPS)
    return {name: step(state) for name, step in STEPS[a:b]}


def normalize_project(main: str, head: str | None = None, profile: Profile | None = None) -> tuple[str, str | None, dict[str, int], list[tuple[int, str, str]]]:
    """(main, preamble, counts by step, notes) without figure widths."""
    state = State(main, head, profile or Profile())
    counts = run_steps(state)
    return state.main, state.head, counts, state.notes


FIELDS = ("paper", "family", "encoding", "body_size", "geometry", "left", "right")
OUT = "source string, preamble string, counts map<string,int>, notes array<struct<line: int, kind: string, detail: string>>"


def _profile(row: dict) -> Profile:
    known = {k: row[k] for k in FIELDS if row.get(k) is not None and row[k] == row[k]}
    p = Profile(**known, keep_markers=bool(row.get("keep_markers", True)))
    p.title = [(e["text"], e["size"]) for e in (row.get("title") if row.get("title") is not None else [])]
    p.labels = dict(row.get("labels") or {})
    return p


def _stage(rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                state = State(row["source"] or "", row.get("preamble"), _profile(row))
                counts = {k: n for k, n in run_steps(state, first, last).items() if n}
                out.append((state.main, state.head, counts, [{"line": a, "kind": k, "detail": d} for a, k, d in state.notes]))
            yield b.drop(columns=["source", "preamble"]).assign(**{name: [x[i] for x in out] for i, name in enumerate(("source", "preamble", "counts", "notes"))})

    kept = [f"`{c}` {t}" for c, t in rows.dtypes if c not in ("source", "preamble")]
    return rows.mapInPandas(run, ", ".join([*kept, OUT]))


def normalized(docs: DataFrame, figs: DataFrame | None = None, sizes: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(doc, source, preamble, counts, notes) of whole projects.

    ``docs``: doc, source and, where known, preamble, the fields of Profile, title
    (array<struct<text, size>>), labels (map<int, string>) and keep_markers. ``figs``, ``sizes``
    and ``files`` as figures.figure_widths takes them; without them widths are left out.
    """
    if "preamble" not in docs.columns:
        docs = docs.withColumn("preamble", F.lit(None).cast("string"))
    if figs is None:
        return _stage(docs, None, None).select("doc", "source", "preamble", "counts", "notes")
    before = _stage(docs, None, WIDTHS_AFTER).withColumnsRenamed({"counts": "counts_a", "notes": "notes_a"})
    edited = figures.with_widths(before, figs, sizes, files)
    after = _stage(edited.withColumnRenamed("outcomes", "notes_b"), WIDTHS_AFTER, None)
    return after.select("doc", "source", "preamble", F.map_concat("counts_a", "counts").alias("counts"), F.concat("notes_a", "notes_b", "notes").alias("notes"))
