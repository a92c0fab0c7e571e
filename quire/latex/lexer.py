"""A LaTeX lexer that knows what is executed.

``Scan`` cuts a source into tokens with one regular expression and marks comments,
verbatim stretches, macro definitions, the document body and page markers. Lines
are cut at LF only; offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property

#: Verbatim environments and what ends them. "executed": the literal end anywhere, the rest
#: of its line is code; "dropped": the same, but the rest of the line is lost; "line": a line of its own.
VERBATIM = {
    "verbatim": "executed", "verbatim*": "executed", "lstlisting": "executed",
    "Verbatim": "dropped", "Verbatim*": "dropped", "minted": "dropped", "comment": "line",
}
#: Commands that define macros, by the shape of their arguments.
DEFINITIONS = {
    "command": ("newcommand", "renewcommand", "providecommand", "DeclareRobustCommand"),
    "def": ("def", "gdef", "edef", "xdef"),
    "let": ("let",),
    "document": ("NewDocumentCommand", "RenewDocumentCommand", "ProvideDocumentCommand", "DeclareDocumentCommand"),
    "environment": ("newenvironment", "renewenvironment"),
}
_SHAPE = {name: shape for shape, names in DEFINITIONS.items() for name in names}
#: Environments that are mathematics, and those whose cells can't be judged by line.
MATH_ENVIRONMENTS = frozenset(
    "math displaymath equation equation* eqnarray eqnarray* align align* alignat alignat* flalign flalign* gather gather* multline multline*".split()
)
ALIGNMENT_ENVIRONMENTS = frozenset(
    "tabular tabular* tabularx tabulary longtable longtable* supertabular supertabular* xtabular xtabular* mpsupertabular tabu longtabu array "
    "NiceTabular NiceTabular* NiceArray tblr longtblr talltblr".split()
)
#: Words of conditionals that don't start with "if".
CONDITIONAL = frozenset("or else fi unless loop repeat".split())

_PIECE = re.compile(r"\\([A-Za-z]+)|\\(.|\n|$)|%[^\n]*|[{}\[\]$&]|\n|[^\\%{}\[\]$&\n]+", re.S)
_MARKER = re.compile(r"[ \t]*%%[ \t]*===[ \t]*Page[ \t]+([0-9]+)[ \t]*===[ \t]*\r?$")


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    kind: str  # word, symbol, comment, verbatim, group ({ }), bracket ([ ]), dollar, amp, newline, text
    name: str


class Scan:
    """Tokens of a source, and questions about its places and lines."""

    def __init__(self, source: str):
        self.source = source
        self.tokens: list[Token] = []
        self._lex()
        self._starts = [t.start for t in self.tokens]
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.definitions = self._definitions()
        self.body = self._body()

    # --- tokens ---

    def _lex(self) -> None:
        s, at, n, add = self.source, 0, len(self.source), self.tokens.append
        while at < n:
            m = _PIECE.match(s, at)
            first, end = s[at], m.end()
            if m[1] is not None:
                if m[1] == "verb":
                    stop = self._verb_end(end)
                    if stop is not None:
                        add(Token(at, end, "word", "verb"))
                        add(Token(end, stop, "verbatim", "verb"))
                        at = stop
                        continue
                add(Token(at, end, "word", m[1]))
                if m[1] == "begin":
                    got = self._raw_argument(end)
                    if got and got[0] in VERBATIM:
                        end = self._verbatim(got[0], end, got[1])
            elif first == "\\":
                add(Token(at, end, "symbol", m[2]))
            elif first == "%":
                add(Token(at, end, "comment", ""))
            else:
                kind = {"{": "group", "}": "group", "[": "bracket", "]": "bracket", "$": "dollar", "&": "amp", "\n": "newline"}.get(first, "text")
                add(Token(at, end, kind, s[at:end] if kind != "text" else ""))
            at = end

    def _verb_end(self, at: int) -> int | None:
        """Where the argument of a verb ends: tabs, a star, blanks, then a delimiter up to its next occurrence
        or the line's end; a line end as delimiter takes the whole next line."""
        s = self.source
        m = re.compile(r"\t*\*?[ \t]*").match(s, at)
        at = m.end()
        if at >= len(s):
            return None
        if re.compile(r"\r?\n").match(s, at):
            at = s.index("\n", at) + 1
            end = s.find("\n", at)
            return len(s) if end < 0 else end
        m = re.compile(re.escape(s[at]) + r"(?:(?!" + re.escape(s[at]) + r"|\r?\n).)*(" + re.escape(s[at]) + r")?", re.S).match(s, at)
        return m.end()

    def _raw_argument(self, at: int) -> tuple[str, int] | None:
        """A braced name after white space and comments: the name and the place after it."""
        m = re.compile(r"(?:[ \t\r\n]|%[^\n]*\n?)*\{([^{}\\%]*)\}").match(self.source, at)
        return (m[1].strip(" \t"), m.end()) if m else None

    def _verbatim(self, name: str, at: int, content: int) -> int:
        """Tokens of the argument, then the verbatim stretch; returns where lexing goes on."""
        s, end_mark = self.source, "\\end{" + name + "}"
        for m in re.compile(r"%[^\n]*|[{}]|\n|[^%{}\n]+").finditer(s, at, content):
            kind = "comment" if m[0][0] == "%" else "group" if m[0] in "{}" else "newline" if m[0] == "\n" else "text"
            self.tokens.append(Token(m.start(), m.end(), kind, m[0] if kind == "group" else ""))
        how = VERBATIM[name]
        if how == "line":
            m = re.compile(r"^" + re.escape(end_mark) + r" *\r?$", re.M).search(s, s.find("\n", content) + 1 if "\n" in s[content:] else len(s))
            close = m.start() if m else len(s)
        else:
            close = s.find(end_mark, content)
            close = len(s) if close < 0 else close
        if content < close:
            self.tokens.append(Token(content, close, "verbatim", name))
        if how == "dropped" and close < len(s):
            after = close + len(end_mark)
            stop = s.find("\n", after)
            stop = len(s) if stop < 0 else stop
            self.tokens.append(Token(close, close + 4, "word", "end"))
            for a, b, kind in ((close + 4, close + 5, "group"), (close + 5, after - 1, "text"), (after - 1, after, "group")):
                self.tokens.append(Token(a, b, kind, s[a:b] if kind == "group" else ""))
            if after < stop:
                self.tokens.append(Token(after, stop, "verbatim", name))
            return stop
        return close

    # --- reading arguments over tokens ---

    def _next(self, i: int) -> int:
        """The next token that isn't blank, a line end or a comment."""
        while i < len(self.tokens) and (self.tokens[i].kind in ("newline", "comment") or self.tokens[i].kind == "text" and not self.source[self.tokens[i].start : self.tokens[i].end].strip()):
            i += 1
        return i

    def _close(self, i: int, open_: str = "{", shut: str = "}") -> int | None:
        """The token after the group or option that starts at token i."""
        depth = 0
        if i >= len(self.tokens) or self.tokens[i].name != open_:
            return None
        for j in range(i, len(self.tokens)):
            name, kind = self.tokens[j].name, self.tokens[j].kind
            if kind == "group":
                depth += 1 if name == "{" else -1
                if depth < 0:
                    return None
            if open_ == "{" and depth == 0 or open_ == "[" and depth == 0 and kind == "bracket" and name == shut:
                return j + 1
        return None

    def argument(self, i: int) -> tuple[str, int, int] | None:
        """The braced argument after token i: its code text, the token after it and its end offset."""
        i = self._next(i + 1)
        j = self._close(i)
        if j is None:
            return None
        return self.code(self.tokens[i].end, self.tokens[j - 1].start).strip(" \t"), j, self.tokens[j - 1].end

    def _definitions(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            shape = _SHAPE.get(t.name) if t.kind == "word" else None
            if shape:
                j = self._definition_end(shape, i)
                out.append((t.start, self.tokens[j - 1].end if j else t.end))
                i = j or i + 1
            else:
                i += 1
        return out

    def _definition_end(self, shape: str, i: int) -> int | None:
        def starred(k: int) -> int:
            k = self._next(k)
            if k < len(self.tokens) and self.tokens[k].kind == "text" and self.source[self.tokens[k].start : self.tokens[k].end].strip() == "*":
                k = self._next(k + 1)
            return k

        def target(k: int) -> int | None:
            k = self._next(k)
            if k >= len(self.tokens):
                return None
            return self._close(k) if self.tokens[k].name == "{" else k + 1

        def options(k: int | None) -> int | None:
            for _ in range(2):
                if k is None:
                    return None
                k = self._next(k)
                if k < len(self.tokens) and self.tokens[k].name == "[":
                    k = self._close(k, "[", "]")
            return None if k is None else self._next(k)

        group = lambda k: None if k is None else self._close(self._next(k))
        if shape == "command":
            return group(options(target(starred(i + 1))))
        if shape == "def":
            k = target(i + 1)
            while k is not None and k < len(self.tokens) and self.tokens[k].name != "{":
                k += 1
            return group(k)
        if shape == "document":
            return group(group(target(i + 1)))
        if shape == "environment":
            return group(group(options(group(starred(i + 1)))))
        return self._let_end(i)

    def _let_end(self, i: int) -> int | None:
        """A let takes a name and one token; an empty line in between is a paragraph, the token itself."""

        def skip(k: int) -> tuple[int, bool]:
            fresh = False
            while k < len(self.tokens):
                t = self.tokens[k]
                if t.kind == "newline":
                    if fresh:
                        return k + 1, True
                    fresh = True
                elif t.kind == "comment":
                    if k + 1 < len(self.tokens) and self.tokens[k + 1].kind == "newline":
                        k += 1
                    fresh = True
                elif t.kind != "text" or self.source[t.start : t.end].strip():
                    break
                k += 1
            return k, False

        k, done = skip(i + 1)
        if done or k >= len(self.tokens):
            return k if done else None
        k, done = skip(k + 1)
        if done:
            return k
        if k < len(self.tokens) and self.tokens[k].kind == "text" and self.source[self.tokens[k].start : self.tokens[k].end].lstrip().startswith("="):
            rest = self.source[self.tokens[k].start : self.tokens[k].end].lstrip()[1:]
            if rest.strip():
                return k + 1
            k, done = skip(k + 1)
            if done:
                return k
        return k + 1 if k < len(self.tokens) else None

    def _body(self) -> tuple[int, int]:
        begin, end = 0, len(self.source)
        seen = False
        for i, t in enumerate(self.tokens):
            if t.kind == "word" and t.name == ("end" if seen else "begin") and not self.in_definition(t.start):
                got = self.argument(i)
                if got and got[0] == "document":
                    if seen:
                        return begin, t.start
                    begin, seen = got[2], True
        return begin, end

    # --- questions ---

    def in_definition(self, at: int) -> bool:
        i = bisect_right(self.definitions, (at, len(self.source) + 1)) - 1
        return i >= 0 and self.definitions[i][0] <= at < self.definitions[i][1]

    def active(self, t: Token) -> bool:
        """Code of the body that is executed where it stands."""
        return t.kind not in ("comment", "verbatim") and self.body[0] <= t.start < self.body[1] and not self.in_definition(t.start)

    def line_of(self, at: int) -> int:
        return bisect_right(self.line_starts, at) - 1

    def line_range(self, line: int) -> tuple[int, int]:
        """A line without its LF."""
        end = self.line_starts[line + 1] - 1 if line + 1 < len(self.line_starts) else len(self.source)
        return self.line_starts[line], end

    def line_text(self, line: int) -> str:
        return self.source[slice(*self.line_range(line))]

    def between(self, a: int, b: int) -> list[Token]:
        i = max(bisect_right(self._starts, a) - 1, 0)
        out = []
        while i < len(self.tokens) and self.tokens[i].start < b:
            if self.tokens[i].end > a:
                out.append(self.tokens[i])
            i += 1
        return out

    def line_tokens(self, line: int) -> list[Token]:
        return self.between(*self.line_range(line))

    def code(self, a: int, b: int) -> str:
        """Code as TeX reads it: a comment goes with its line end and the next line's leading blanks."""
        out, skip = [], False
        for t in self.between(a, b):
            text = self.source[max(a, t.start) : min(b, t.end)]
            if t.kind == "comment":
                skip = True
            elif t.kind != "verbatim":
                if skip:
                    text = text.lstrip(" \t\r\n") if t.kind in ("text", "newline") else text
                    skip = not text
                out.append(text)
        return "".join(out)

    @cached_property
    def marker_lines(self) -> list[tuple[int, int, bool]]:
        """(line, page, in the body) of every page marker that is a comment of its own."""
        out = []
        for t in self.tokens:
            if t.kind == "comment":
                line = self.line_of(t.start)
                m = _MARKER.match(self.line_text(line))
                if m and not self.source[self.line_starts[line] : t.start].strip(" \t") and not self.in_definition(t.start):
                    out.append((line, int(m[1]), self.body[0] <= t.start < self.body[1]))
        return out

    @cached_property
    def verbatim_texts(self) -> list[str]:
        return [self.source[t.start : t.end] for t in self.tokens if t.kind == "verbatim"]

    def touches_verbatim(self, line: int) -> bool:
        a, b = self.line_range(line)
        return any(t.kind == "verbatim" and (t.end > t.start) and t.start <= b and t.end > a or t.kind == "word" and t.name == "verb" for t in self.between(a, b + 1))

    def looks_like_prose(self, line: int) -> bool:
        """A letter remains without control sequences, and the line doesn't start as an argument or a cell."""
        text = self.line_text(line).lstrip(" \t")
        if not text or text[0] in "{[}]&" or text.startswith("\\\\"):
            return False
        a, b = self.line_range(line)
        return any(c.isalpha() for t in self.between(a, b) if t.kind == "text" for c in self.source[max(a, t.start) : min(b, t.end)])

    def ends_with_control(self, line: int) -> bool | None:
        """Whether the line's code ends in a control sequence; None for a line without code."""
        a, b = self.line_range(line)
        for t in reversed(self.between(a, b)):
            if t.kind in ("comment", "verbatim", "newline") or t.kind == "text" and not self.source[max(a, t.start) : min(b, t.end)].strip():
                continue
            return t.kind in ("word", "symbol")
        return None

    def balanced(self, lines: list[int]) -> bool:
        """Whether the lines open and close their own groups, environments and mathematics; never with conditionals."""
        stack: list[str] = []
        for line in lines:
            end = self.line_range(line)[1]
            skip = -1
            for t in self.line_tokens(line):
                if t.start < skip or t.kind in ("comment", "verbatim"):
                    continue
                if t.kind == "word" and t.name in ("begin", "end"):
                    got = self.argument(bisect_right(self._starts, t.start) - 1)
                    if not got or got[2] > end:
                        return False
                    skip = got[2]
                if not _track(stack, t, got[0] if t.kind == "word" and t.name in ("begin", "end") else "", self.source):
                    return False
        return not stack

    def _modes(self, names: frozenset[str], math: bool) -> list[bool] | None:
        """For each line start: inside one of the environments (or mathematics); None if nesting doesn't fit."""
        stack: list[str] = []
        out = [False] * len(self.line_starts)
        line, skip = 0, -1

        def close(what: str) -> bool:
            if not stack or stack[-1] != what:
                return False
            stack.pop()
            return True

        prev = -1
        for i, t in enumerate(self.tokens):
            while line + 1 < len(self.line_starts) and self.line_starts[line + 1] <= t.start:
                line += 1
                out[line] = bool(stack)
            if t.start < skip or not self.active(t):
                continue
            if t.kind == "word" and t.name in ("begin", "end"):
                got = self.argument(i)
                if got:
                    skip = got[2]
                    if got[0] in names:
                        if t.name == "begin":
                            stack.append(got[0])
                        elif not close(got[0]):
                            return None
            elif math and t.kind == "symbol" and t.name in "()[]" and t.name:
                if t.name in "([":
                    stack.append(t.name)
                elif not close({")": "(", "]": "["}[t.name]):
                    return None
            elif math and t.kind == "dollar" and t.start != prev:
                if stack and stack[-1] == "$":
                    stack.pop()
                elif self.source[t.end : t.end + 1] == "$":
                    prev = t.end
                    if stack and stack[-1] == "$$":
                        stack.pop()
                    else:
                        stack.append("$$")
                else:
                    stack.append("$")
        while line + 1 < len(self.line_starts):
            line += 1
            out[line] = bool(stack)
        return None if stack else out

    def math_lines(self) -> list[bool] | None:
        return self._modes(MATH_ENVIRONMENTS, True)

    def alignment_lines(self) -> list[bool] | None:
        return self._modes(ALIGNMENT_ENVIRONMENTS, False)

    def rows(self) -> list[tuple[int, int, int, str, str, bool]]:
        """(start, end, line, kind, name, active) of every token but plain text."""
        return [(t.start, t.end, self.line_of(t.start), t.kind, t.name, self.active(t)) for t in self.tokens if t.kind not in ("text", "newline")]


_PAIRS = {"endgroup": "begingroup", "egroup": "bgroup", "right": "left"}


def _track(stack: list[str], t: Token, env: str, source: str) -> bool:
    """One token's effect on what is open; False if something doesn't fit."""

    def close(what: str) -> bool:
        if not stack or stack[-1] != what:
            return False
        stack.pop()
        return True

    if t.kind == "word":
        if t.name == "begin":
            stack.append("env:" + env)
        elif t.name == "end":
            return close("env:" + env)
        elif t.name in _PAIRS.values():
            stack.append(t.name)
        elif t.name in _PAIRS:
            return close(_PAIRS[t.name])
        elif t.name.startswith("if") or t.name in CONDITIONAL:
            return False
    elif t.kind == "symbol" and t.name in ("[", "("):
        stack.append("\\" + t.name)
    elif t.kind == "symbol" and t.name in ("]", ")"):
        return close("\\[" if t.name == "]" else "\\(")
    elif t.kind == "group":
        if t.name == "{":
            stack.append("{")
        else:
            return close("{")
    elif t.kind == "dollar":
        if stack and stack[-1] == "$":
            stack.pop()
        elif source[t.start - 1 : t.start] == "$" and stack and stack[-1] == "half":
            stack.pop()
            if stack and stack[-1] == "$$":
                stack.pop()
            else:
                stack.append("$$")
        elif source[t.end : t.end + 1] == "$":
            stack.append("half")
        else:
            stack.append("$")
    return True
