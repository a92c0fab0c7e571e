"""Preamble passes, and passes over lines that need to know the page: fonts, title sizes, packages, line breaks, manual chapters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.latex.passes import visible_length

T1_LINE = "\\usepackage[T1]{fontenc}"
#: By family, packages whose lines go, and the line that is added unless one of the marks is there.
FONT_PACKAGES = {
    "computerModern": (("lmodern", "newtxtext", "newtxmath", "newpxtext", "newpxmath", "times", "palatino"), (), None),
    "latinModern": ((), ("\\usepackage{lmodern}",), "\\usepackage{lmodern}"),
    "times": (("lmodern",), ("newtxtext", "\\usepackage{times}"), "\\usepackage{newtxtext,newtxmath}"),
    "palatino": (("lmodern",), ("newpxtext", "\\usepackage{palatino}"), "\\usepackage{newpxtext,newpxmath}"),
}
#: Size commands and their points in a class of 11 points, largest first.
SIZES = (
    ("\\Huge", 24.88), ("\\huge", 20.74), ("\\LARGE", 17.28), ("\\Large", 14.40), ("\\large", 12.0),
    ("\\normalsize", 10.95), ("\\small", 9.0), ("\\footnotesize", 8.0), ("\\scriptsize", 7.0), ("\\tiny", 5.0),
)
#: Commands that carry no text of their own.
SILENT = (
    "\\bfseries", "\\textsc", "\\textbf", "\\textsuperscript", "\\par", "\\vspace", "\\hspace",
    "\\Huge", "\\huge", "\\LARGE", "\\Large", "\\large", "\\normalsize", "\\small", "\\footnotesize", "\\scriptsize", "\\tiny",
    "\\fontsize", "\\selectfont", "\\centering",
)
#: What in a page asks for which package.
PACKAGE_RULES = (
    ("\\begin{tikzpicture}", "tikz"), ("\\begin{algorithm}", "algorithm2e"), ("\\begin{lstlisting}", "listings"), ("\\begin{minted}", "minted"),
    ("\\begin{enumerate}", "enumitem"), ("\\begin{itemize}", "enumitem"), ("\\begin{multicols}", "multicol"), ("\\begin{subfigure}", "subcaption"),
    ("\\begin{landscape}", "lscape"), ("\\begin{longtable}", "longtable"), ("\\begin{align", "amsmath"), ("\\mathbb{", "amssymb"),
    ("\\mathcal{", "amsmath"), ("\\boldsymbol{", "amsmath"), ("\\xrightarrow", "mathtools"), ("\\underbrace", "amsmath"),
    ("\\cancel{", "cancel"), ("\\bm{", "bm"),
)
#: Environments whose line ends mean something.
STRUCTURAL = frozenset((
    "tabular", "tabularx", "array", "matrix", "pmatrix", "bmatrix", "vmatrix", "Vmatrix", "cases", "align", "align*", "aligned",
    "gather", "gather*", "gathered", "eqnarray", "eqnarray*", "split", "multline", "multline*", "flalign", "flalign*",
))
FRAMES = frozenset(("minipage", "fbox"))
#: How a line of prose may begin.
PROSE = (
    "printed", "but ", "and ", "or ", "the ", "a ", "an ", "for ", "to ", "of ", "in ", "on ", "with ", "that ", "this ", "is ", "are ", "was ", "were ", "not ",
)
#: Commands that only make room, and how many lines below "Chapter N" its title may stand.
ROOM, TITLE_WITHIN = frozenset(("\\bigskip", "\\medskip", "\\smallskip", "\\newpage", "\\clearpage", "\\noindent")), 8
CHAPTER_SIZES = ("LARGE", "Large", "Huge", "huge", "large", "normalsize")


# --- fonts ---


def _without(lines: Iterable[str], drop) -> str:
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(x for x in lines if not drop(x)))


def _behind(source: str, anchor: str, line: str) -> tuple[str, bool]:
    """``line`` put below the first line that holds ``anchor``."""
    before, found, after = source.partition(anchor)
    rest, eol, more = after.partition("\n")
    return (before + found + rest + "\n" + line + eol + more, True) if found else (source, False)


def font_encoding(source: str, encoding: str) -> str:
    """T1 is loaded below the class; OT1, the default, has its T1 lines taken out."""
    has = T1_LINE in source
    if encoding == "T1" and not has:
        return _behind(source, "\\documentclass", T1_LINE)[0]
    return _without(source.split("\n"), lambda x: T1_LINE in x) if encoding == "OT1" and has else source


def font_package(source: str, family: str, encoding: str = "T1") -> str:
    """Encoding and font package of a family; unknown families leave the source alone, helvetica gets its encoding only."""
    if family == "unknown":
        return source
    source = font_encoding(source, encoding)
    dropped, marks, line = FONT_PACKAGES.get(family, ((), (), None))
    for package in dropped:
        loads = lambda x, p=package: x.strip(" \t").startswith("\\usepackage{") and p in x and "fontenc" not in x
        source = _without(source.split("\n"), loads)
    if line is None or any(m in source for m in marks):
        return source
    for anchor in (T1_LINE, "\\documentclass"):
        source, done = _behind(source, anchor, line)
        if done:
            return source
    return source + "\n" + line


# --- title page ---


def clean_for_matching(line: str) -> str:
    """The text of a line without commands and braces."""
    out = line.replace("\\textcopyright{}", "©").replace("\\textcopyright", "©")
    for command in SILENT:
        out = out.replace(command, "")
    return re.sub(" {2,}", " ", out.replace("{", " ").replace("}", " ").replace("\\\\", "")).strip()


def _letters(text: str) -> str:
    return "".join(c for c in text if c.isalnum()).upper()


def points_text(value: float) -> str:
    return str(int(value)) if value == int(value) else f"{value:.1f}"


def size_command(points: float) -> str:
    r"""The size command within 1.5 points, else \fontsize with a leading of 1.2."""
    command, nearest = min(SIZES, key=lambda s: abs(s[1] - points))
    if abs(nearest - points) <= 1.5:
        return command
    return f"\\fontsize{{{points_text(points)}}}{{{points_text(float(int(points * 1.2 + 0.5)))}}}\\selectfont"


def title_sizes(source: str, elements: list[tuple[str, float]]) -> str:
    """Size commands on the title page that are half a point or more off the size of the text they set.

    A line goes by the first element, in order, whose first eight letters and digits begin it, or are begun by it."""
    keyed = [(key, size) for text, size in elements if len(text) >= 3 and len(key := _letters(text)) >= 3]
    before, begin, rest = source.partition("\\begin{titlepage}")
    body, end, after = rest.partition("\\end{titlepage}")
    if not begin or not end or not keyed:
        return source

    def fixed(line: str) -> str:
        used = next(((c, p) for c, p in SIZES if c in line), None)
        key = _letters(clean_for_matching(line)) if used else ""
        target = next((size for k, size in keyed if key.startswith(k[:8]) or k.startswith(key[:8])), None) if len(key) >= 3 else None
        if target is None or abs(used[1] - target) < 0.5:
            return line
        return line.replace(used[0], size_command(target))

    return before + begin + "\n".join(map(fixed, body.split("\n"))) + end + after


# --- packages ---


def wanted_packages(content: Column, preamble: Column) -> Column:
    """Packages that the content asks for and the preamble doesn't load, in the order of the rules, repeated as rules repeat them."""
    rules = F.array(*[F.struct(F.lit(sign).alias("sign"), F.lit(name).alias("name")) for sign, name in PACKAGE_RULES])

    def missing(r: Column) -> Column:
        loaded = F.lit(False)
        for a, b in (("\\usepackage{", "}"), ("\\usepackage[", "]"), (",", "}"), (",", ","), ("{", ",")):
            loaded = loaded | F.contains(preamble, F.concat(F.lit(a), r["name"], F.lit(b)))
        return F.contains(content, r["sign"]) & ~loaded

    return F.transform(F.filter(rules, missing), lambda r: r["name"])


def with_packages(preamble: Column, names: Column) -> Column:
    lines = F.array_join(F.transform(names, lambda n: F.concat(F.lit("\\usepackage{"), n, F.lit("}"))), "\n")
    return F.when(F.size(names) > 0, F.concat(preamble, F.lit("\n% Auto-detected packages\n"), lines, F.lit("\n"))).otherwise(preamble)


def external_preamble(docs: DataFrame, files: DataFrame, first_lines: int = 20) -> DataFrame:
    r"""(doc, path): the first \input among a document's first lines, comments passed over, whose file holds a class.

    ``docs``: doc, source; ``files``: doc, path, source."""
    lines = docs.select("doc", F.posexplode(F.slice(F.split("source", "\n", -1), 1, first_lines)).alias("at", "line"))
    name = F.regexp_extract(F.trim("line"), r"\\input\{([^}]+)\}", 1)
    asked = lines.where(~F.trim("line").startswith("%")).withColumn("name", name).where("name != ''")
    path = F.when(F.col("name").endswith(".tex"), F.col("name")).otherwise(F.concat("name", F.lit(".tex")))
    known = files.where(F.contains("source", F.lit("\\documentclass"))).select("doc", "path")
    return asked.withColumn("path", path).join(known, ["doc", "path"], "left_semi").groupBy("doc").agg(F.min_by("path", "at").alias("path"))


# --- lines ---


def _environments(line: str, stack: list[str]) -> None:
    stack += re.findall(r"\\begin\{(\w+\*?)\}", line)
    for name in re.findall(r"\\end\{(\w+\*?)\}", line):
        if name in stack:
            del stack[len(stack) - 1 - stack[::-1].index(name)]


def _is_prose(line: str) -> bool:
    return line[:1].islower() or line.lower().startswith(PROSE)


def line_breaks(source: str, chars_per_line: float) -> tuple[str, int]:
    r"""``\\`` at the end of a line that is about as long as the page is wide goes, and the next line of prose joins.

    Lines in structural environments, frames, with dot leaders or without text keep theirs."""
    shortest, longest = int(chars_per_line * 0.75), int(chars_per_line * 1.2)
    stack: list[str] = []
    out: list[str] = []
    n, joined = 0, False

    for line, following in _pairs(source.split("\n")):
        bare = line.strip(" \t")
        if joined:  # the line is part of the one before it
            joined = False
            continue
        _environments(bare, stack)
        text = bare[:-2].strip(" \t") if bare.endswith("\\\\") else ""
        kept = not text or "\\dotfill" in text or not STRUCTURAL.isdisjoint(stack) or not FRAMES.isdisjoint(stack)
        if kept or not shortest <= visible_length(text) <= longest:
            out.append(line)
            continue
        head, _, tail = line.rpartition("\\\\")
        cleaned, after = (head + tail).strip(" "), (following or "").strip(" \t")
        joined = bool(after) and (not after.startswith(("\\", "%")) or _is_prose(after))
        out.append(f"{cleaned} {after}" if joined else cleaned)
        n += 1
    return "\n".join(out), n


def _pairs(lines: list[str]) -> Iterator[tuple[str, str | None]]:
    return zip(lines, [*lines[1:], None], strict=True)


def chapter_title(line: str) -> str:
    """The title of a line that sets it by hand: size, bold face, centring and \\noindent taken off."""
    text = line
    if text.startswith("{") and text.endswith("\\par}"):
        text = text[1:-5].replace("\\centering", "").strip(" \t")
    text = text.replace("\\noindent", "").strip(" \t")
    size = "|".join(CHAPTER_SIZES)
    for shape in (rf"\{{\\(?:{size})\s*\\textbf\{{(.+)\}}\}}", rf"\{{\\(?:{size})\s*\\bfseries\s+(.+)\}}", r"\\textbf\{(.+)\}", r"\\bfseries (.*)"):
        if m := re.fullmatch(shape, text):
            return m[1].strip(" \t")
    return text


def manual_chapters(source: str) -> str:
    r"""A bold "Chapter N" with its title on a line below becomes \chapter{title}; blank and spacing lines around it go."""
    lines = source.split("\n")
    bare = [x.strip(" \t") for x in lines]
    room = [not x or x in ROOM or x.startswith("\\vspace") for x in bare]
    following = [len(lines)] * (len(lines) + 1)  # the next line from here on that isn't room
    for i in range(len(lines) - 1, -1, -1):
        following[i] = following[i + 1] if room[i] else i
    out, at = [], 0
    while at < len(lines):
        by_hand = not bare[at].startswith("\\chapter") and re.search(r"\\textbf\{Chapter\s+[0-9]+\}|\\bfseries\s+Chapter\s+[0-9]+", bare[at])
        j = following[at + 1] if by_hand else len(lines)
        title = chapter_title(bare[j]) if j < len(lines) and j <= at + TITLE_WITHIN else ""
        if title and not re.match(r"[0-9]+\.[0-9]+", title):
            out.append(f"\\chapter{{{title}}}")
            at = following[j + 1]
        else:
            out.append(lines[at])
            at += 1
    return "\n".join(out)
