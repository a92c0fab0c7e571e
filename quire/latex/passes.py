"""Rewrite passes on LaTeX sources. Each maps a text to a text and leaves its own output alone.

Simple passes are regular expressions over the text or folds over its lines; the
structural ones use :class:`quire.latex.lexer.Scan`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

from quire.latex.lexer import Scan

PAPERS = ("a4paper", "letterpaper", "legalpaper", "b5paper")
#: Operators that sources use without defining them; True where the name is taken already.
OPERATORS = {
    "E": False, "var": False, "cov": False, "corr": False, "avar": False, "rank": False, "tr": False, "diag": False, "vec": True,
    "plim": False, "argmin": False, "argmax": False, "sgn": False, "supp": False, "med": False,
}
#: A package and what in a source asks for it.
PACKAGES = {"xcolor": ("\\begin{figure}", "\\begin{table}", "\\includegraphics")}


def _by_line(source: str, keep: Callable[[list[str]], list[str]]) -> str:
    return "\n".join(keep(source.split("\n")))


# --- preamble ---


def book_class(source: str, has_chapters: bool) -> str:
    r"""article becomes book where there are chapters."""
    return re.sub(r"\\documentclass(\[[^\]]*\])?\{article\}", lambda m: f"\\documentclass{m[1] or ''}{{book}}", source, count=1) if has_chapters else source


def paper_size(source: str, target: str) -> str:
    return source if target not in PAPERS or target in source else re.sub("|".join(PAPERS), target, source)


def font_size(source: str, size: float) -> str:
    """The class option for 10, 11 or 12 points."""
    if size not in (10.0, 11.0, 12.0):
        return source
    option = f"{size:.0f}pt"
    m = re.search(r"\\documentclass\[([^\]]*)\]", source)
    if not m or option in m[1]:
        return source
    options = re.sub(r"\b1[012]pt\b", option, m[1])
    if options == m[1]:
        options = ",".join(filter(None, (option, m[1])))
    return source[: m.start(1)] + options + source[m.end(1) :]


def margins(source: str, geometry: str) -> str:
    """Options of a geometry package that is loaded already."""
    return re.sub(r"\\usepackage(\[[^\]]*\])?\{geometry\}", lambda m: f"\\usepackage[{geometry}]{{geometry}}", source)


def _defined(name: str, source: str) -> bool:
    return bool(re.search(r"\\(?:DeclareMathOperator|(?:re)?newcommand)\*?\{?\\" + name + r"\}?(?![A-Za-z])|\\def\\" + name + r"(?![A-Za-z])", source))


def missing_operators(main: str, preamble: str = "") -> list[str]:
    used = set(re.findall(r"\\([A-Za-z]+)", main))
    return [n for n in OPERATORS if n in used and not _defined(n, preamble) and not _defined(n, main)]


def add_operators(source: str, names: list[str]) -> str:
    r"""Definitions before the document begins, or at the start."""
    if not names:
        return source
    lines = ["% Math operators (auto-detected)"]
    for n in names:
        lines += [f"\\let\\{n}\\relax"] * OPERATORS.get(n, False) + [f"\\DeclareMathOperator{{\\{n}}}{{{n}}}"]
    at = max(source.find("\\begin{document}"), 0)
    return source[:at] + "\n".join(lines) + "\n" + source[at:]


def missing_packages(main: str, preamble: str) -> list[str]:
    loaded = set(re.split(r"\s*,\s*", ",".join(re.findall(r"\\usepackage(?:\[[^\]]*\])?\{([^}]*)\}", preamble))))
    return [p for p, signs in PACKAGES.items() if p not in loaded and any(s in main for s in signs)]


def add_packages(preamble: str, names: list[str]) -> str:
    return preamble.strip("\n") + "\n\n% Auto-detected packages\n" + "".join(f"\\usepackage{{{n}}}\n" for n in names) if names else preamble


# --- lines ---


def copyright_signs(source: str) -> str:
    return source.replace("$\\copyright\\$", "\\textcopyright{}").replace("$\\copyright$", "\\textcopyright{}")


def duplicate_chapters(source: str) -> str:
    """Of neighbouring chapters with one title, the line of the first goes."""

    def keep(lines: list[str]) -> list[str]:
        found = [(i, m[1]) for i, x in enumerate(lines) if (m := re.fullmatch(r"\\chapter\{(.+)\}", x.strip(" \t")))]
        gone = {i for (i, t), (_, u) in zip(found, found[1:], strict=False) if t == u}
        return [x for i, x in enumerate(lines) if i not in gone]

    return _by_line(source, keep)


def verbatim_in_fbox(source: str) -> str:
    r"""A frame around verbatim text is unwrapped: its own line, and the brace line that closes it."""

    def keep(lines: list[str]) -> list[str]:
        bare = [x.strip(" \t") for x in lines]
        gone, ends = set(), set()
        for i, x in enumerate(bare):
            if x == "\\fbox{%":
                j = next((j for j in range(i + 1, len(bare)) if bare[j] == "}"), None)
                if j is not None and any("\\begin{verbatim}" in y for y in bare[i + 1 : j]):
                    gone |= {i, j}
                    ends.add(j - 1)
        return [x.replace("\\end{minipage}%", "\\end{minipage}") if i in ends else x for i, x in enumerate(lines) if i not in gone]

    return _by_line(source, keep)


def equation_splits(source: str) -> str:
    r"""A \] line followed by a \[ line inside an equation: both go."""

    def keep(lines: list[str]) -> list[str]:
        out, inside, at = [], False, 0
        while at < len(lines):
            x = lines[at].strip(" \t")
            inside = (inside or x.startswith("\\begin{equation")) and not x.startswith("\\end{equation")
            if inside and x == "\\]" and at + 1 < len(lines) and lines[at + 1].strip(" \t") == "\\[":
                at += 2
                continue
            out.append(lines[at])
            at += 1
        return out

    return _by_line(source, keep)


def tags_after_aligned(source: str) -> str:
    r"""The last \tag line inside aligned moves behind its end."""

    def keep(lines: list[str]) -> list[str]:
        out, inside, tag = [], False, None
        for line in lines:
            x = line.strip(" \t")
            inside = inside or x.startswith("\\begin{aligned")
            if inside and re.fullmatch(r"\\tag\{[^}]*\}", x):
                tag = x
                continue
            out.append(line)
            if x.startswith("\\end{aligned"):
                inside = False
                if tag is not None:
                    out.append(tag)
                    tag = None
        return out

    return _by_line(source, keep)


def misescaped_dollars(source: str) -> tuple[str, int]:
    r"""``\$5 ... $`` on a line, outside mathematics, is mathematics whose first dollar was escaped."""
    n = 0

    def line(text: str) -> str:
        nonlocal n
        out, at = "", 0
        for m in re.finditer(r"\\\$(?=(\d+(?:\.\d+)?))", text):
            out += text[at : m.start()]
            outside = len(re.findall(r"(?<!\\)\$", out)) % 2 == 0
            closes = re.search(r"(?<!\\)\$", text[m.end(1) :]) is not None
            out += "$" if outside and closes else "\\$"
            n += outside and closes
            at = m.end()
        return out + text[at:]

    fixed = "\n".join(map(line, source.split("\n")))
    return fixed, n


def currency(source: str) -> tuple[str, int]:
    """A dollar before a digit is escaped unless it has an odd number of backslashes, or its line starts as mathematics."""
    n = 0

    def line(text: str) -> str:
        nonlocal n
        if re.match(r"\s*(\$|\\\(|\\\[)", text):
            return text
        fixed, k = re.subn(r"(?<!\\)((?:\\\\)*)\$(?=[0-9])", r"\1\\$", text)
        n += k
        return fixed

    return "\n".join(map(line, source.split("\n"))), n


def end_document(source: str) -> str:
    has_end = "\\end{document}" in source
    return source if has_end or "\\begin{document}" not in source else source.strip() + "\n\n\\end{document}\n"


def strip_markers(source: str) -> str:
    if "===" not in source:
        return source
    gone = {line for line, _, _ in Scan(source).marker_lines}
    return "\n".join(x for i, x in enumerate(source.split("\n")) if i not in gone)


def symbols(source: str, table: list[tuple[str, str]]) -> str:
    for old, new in table:
        source = source.replace(old, new)
    return source


def visible_length(line: str) -> int:
    """Characters that remain when commands are unwrapped, innermost first, and braces are dropped."""
    while True:
        inner = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", line)
        if inner == line:
            break
        line = inner
    return len(re.sub(r"[{}]", "", re.sub(r"\\[A-Za-z]+\*?", "", line)).strip())


# --- environments ---


def environment_issues(source: str) -> list[tuple[str, str, int]]:
    r"""(kind, environment, line from 1): extraClose, mismatch (the one that was opened) and unclosed."""
    stack: list[tuple[str, int]] = []
    out = []
    for i, line in enumerate(source.split("\n"), 1):
        for m in re.finditer(r"\\(begin|end)\{([^}]+)\}", line):
            if m[1] == "begin":
                stack.append((m[2], i))
            elif not stack:
                out.append(("extraClose", m[2], i))
            else:
                name, at = stack.pop()
                if name != m[2]:
                    out.append(("mismatch", name, at))
    return out + [("unclosed", name, at) for name, at in stack]


def repair_environments(source: str) -> str:
    """Ends without a beginning go if they are their line; what stays open is closed at the end. Mismatches stay."""
    lines = source.split("\n")
    gone = {i for kind, _, i in environment_issues(source) if kind == "extraClose" and re.fullmatch(r"\\end\{[^}]+\}", lines[i - 1].strip(" \t"))}
    kept = [x for i, x in enumerate(lines, 1) if i not in gone]
    still = [name for kind, name, _ in environment_issues("\n".join(kept)) if kind == "unclosed"]
    return "\n".join(kept + [f"\\end{{{name}}}" for name in reversed(still)])


# --- pages ---


def duplicate_plan(source: str, window: int = 5, vetoes: bool = True) -> tuple[set[int], set[int]]:
    """(planned, deleted): lines repeated across page boundaries.

    At each marker the last comparable lines of a page meet the first of the next;
    the largest balanced overlap is planned, again and again until there is none.
    Blank and %% lines are passed over, lines that touch verbatim text stop the
    search. A planned block is deleted unless a line isn't prose, the boundary lies
    in mathematics or in an alignment, or a control sequence stands before the
    repeated lines or at their end. Lines that a veto keeps stay planned.
    """
    planned: set[int] = set()
    deleted: set[int] = set()
    if window <= 0 or "===" not in source:
        return planned, deleted
    scan = Scan(source)
    marks = [line for line, _, _ in scan.marker_lines]
    keys = [x.strip(" \t\r") for x in source.split("\n")]
    passed = [not k or k.startswith("%%") for k in keys]
    wall = [scan.touches_verbatim(i) for i in range(len(keys))]
    math, cells = scan.math_lines(), scan.alignment_lines()

    def gather(rows: range) -> list[int]:
        out: list[int] = []
        for i in rows:
            if wall[i] or len(out) == window:
                break
            if not passed[i] and i not in planned:
                out.append(i)
        return out

    def waits(before: int) -> bool:
        """The last code before a line ends in a control sequence that could take an argument."""
        for i in range(before - 1, -1, -1):
            if not passed[i] and i not in deleted:
                ends = scan.ends_with_control(i)
                if ends is not None:
                    return ends
        return False

    for n, mark in enumerate(marks):
        tail = gather(range(mark - 1, marks[n - 1] if n else -1, -1))[::-1]
        stop = marks[n + 1] if n + 1 < len(marks) else len(keys)
        while True:
            head = gather(range(mark + 1, stop))
            fits = (
                k for k in range(min(len(tail), len(head)), 0, -1)
                if [keys[i] for i in tail[-k:]] == [keys[i] for i in head[:k]] and scan.balanced(head[:k])
            )
            k = next(fits, 0)
            if not k:
                break
            block = head[:k]
            planned.update(block)
            fine = math is not None and not math[mark] and cells is not None and not cells[mark]
            fine = fine and all(map(scan.looks_like_prose, block)) and not waits(tail[-k]) and scan.ends_with_control(block[-1]) is not True
            if fine or not vetoes:
                deleted.update(block)
    return planned, deleted


def page_duplicates(source: str, window: int = 5) -> str:
    """Lines repeated across page boundaries removed; nothing if verbatim text would change."""
    _, gone = duplicate_plan(source, window)
    if not gone:
        return source
    out = "\n".join(x for i, x in enumerate(source.split("\n")) if i not in gone)
    return out if Scan(out).verbatim_texts == Scan(source).verbatim_texts else source


def normalize(source: str, table: list[tuple[str, str]] | None = None, markers: bool = True) -> tuple[str, dict[str, int]]:
    """The passes that need nothing but the text, with whether each changed it: class, symbols, page duplicates, markers.

    Whole projects go through quire.latex.project.
    """
    counts: dict[str, int] = {}
    for name, step in (
        ("book_class", lambda s: book_class(s, "\\chapter{" in s)),
        ("symbols", lambda s: symbols(s, table or [])),
        ("page_duplicates", page_duplicates),
        ("markers", lambda s: s if markers else strip_markers(s)),
    ):
        text = step(source)
        source, counts[name] = text, int(text != source)
    return source, counts


# --- compile logs ---

#: What makes a message behind file and line an error, and what a message of each category says; a
#: category holds if all words of one of its lists occur, the first category that holds counts.
_ERRORS = (
    "undefined control sequence", "missing $", "missing \\$", "missing }", "missing \\}", "missing {", "missing \\{", "latex error",
    "emergency stop", "extra }", "runaway argument", "too many }'s",
)
CATEGORIES = (
    ("undefined_command", (("undefined control sequence",),)),
    ("missing_math", (("missing $ inserted",), ("missing \\$ inserted",))),
    ("missing_brace", (("missing } inserted",), ("missing \\} inserted",))),
    ("environment", (("\\begin{", "ended by"), ("environment", "undefined"), ("environment", "ended"))),
)
#: How many lines below a message its line number may stand.
NUMBER_WITHIN = 4


def error_category(message: str) -> str:
    low = message.lower()
    return next((name for name, lists in CATEGORIES if any(all(w in low for w in words) for words in lists)), "other")


def log_errors(log: str) -> list[tuple[str, int | None, str]]:
    """(category, line, message): errors that start with ! and take their line from the lines below, or file:line: message."""
    found: list[tuple[int, int | None, str]] = []  # (row, line, message)
    numbers: list[tuple[int, int]] = []  # (row, line) of rows like l.12
    for row, raw in enumerate(log.split("\n")):
        line = raw.strip(" \t")
        where, _, rest = line.partition(":")
        at, _, said = rest.partition(":")
        if line.startswith("!"):
            found.append((row, None, line[1:].strip(" \t")))
        elif where and at.isascii() and at.isdecimal() and said.strip() and any(e in said.lower() for e in _ERRORS):
            found.append((row, int(at), said.strip()))
        digits = raw.lstrip()[2:]
        if raw.lstrip().startswith("l.") and digits[:1].isascii() and digits[:1].isdecimal():
            numbers.append((row, int(digits[: len(digits) - len(digits.lstrip("0123456789"))])))
    rows = [row for row, _ in numbers]
    out = []
    for row, line, message in found:
        k = bisect_right(rows, row)
        if line is None and k < len(rows) and rows[k] <= row + NUMBER_WITHIN:
            line = numbers[k][1]
        out.append((error_category(message), line, message))
    return out


def warnings(log: str) -> int:
    return log.count("LaTeX Warning:")
