"""Text metrics as column expressions: normalization, token sets, coverage, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Presentation forms and symbol variants, and what they are read as.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
SYMBOLS = (
    ("−", "-"), ("–", "-"), ("—", "-"), ("×", "x"), ("·", "."), ("′", "'"), ("″", "''"),
    ("≤", "<="), ("≥", ">="), ("≠", "!="), ("→", "->"), ("←", "<-"), ("⇒", "=>"),
    ("\u00a0", " "), ("\u2009", " "), ("\u200b", ""), ("\ufeff", ""),
)
#: White space of any kind, and what makes a token more than punctuation; the same in Java and RE2.
SPACES = r"[\s\x{0085}\p{Z}]+"
ALNUM = r"[\p{L}\p{M}\p{N}]"
#: Characters that make a token mathematical.
MATH_CHARS = "0123456789=+−×÷≤≥≠∞∑∫∂∇√∈∉⊂⊃∀∃∧∨¬⟹⟺→←↔≈≡∝∅∪∩"
MATH_TOKEN = f"[{MATH_CHARS}Α-ω]"


def replaced(c: Column, table) -> Column:
    for old, new in table:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def tokens(c: Column) -> Column:
    """Normalized tokens: variants unified, split at white space, punctuation-only tokens dropped, lower case."""
    unified = replaced(c, LIGATURES + SYMBOLS)
    words = F.filter(F.split(unified, SPACES), lambda w: w.rlike(ALNUM))
    return F.transform(words, F.lower)


def normalized(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def simple_tokens(c: Column) -> Column:
    """As ``tokens`` without the unification, for texts that are known to hold no variants."""
    return F.filter(F.split(F.lower(c), SPACES), lambda w: w.rlike(ALNUM))


def is_math(word: Column) -> Column:
    """A digit, operator or Greek letter, or a single character that isn't a letter."""
    return word.rlike(MATH_TOKEN) | ((F.length(word) == 1) & ~word.rlike(r"\p{L}"))


def set_coverage(a: Column, b: Column) -> Column:
    """|A & B| / |A| of two arrays as sets; for an empty A 1 if B is empty as well, else 0."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, "")


def char_ngrams(c: Column, n: int = 2) -> Column:
    """The n-character pieces at every place; none for shorter texts.

    Characters are cut out once: a substring of UTF-8 text costs its distance from the start.
    """
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    pieces = chars
    for k in range(2, n + 1):
        pieces = F.zip_with(pieces, F.slice(chars, F.lit(k), F.size(chars)), lambda a, b: F.concat(a, b))
    return F.filter(pieces, lambda x: x.isNotNull())


def truncated(c: Column, head: int = 2000, tail: int = 4000, slack: int = 100, mark: str = "\n[...]\n") -> Column:
    """Head and tail of a text longer than head + tail + slack characters."""
    cut = F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(tail)))
    return F.when(F.length(c) > head + tail + slack, cut).otherwise(c)


def slug(c: Column, fallback: str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, no dash at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def without_subset_prefix(c: Column) -> Column:
    """A font's name after the first plus sign."""
    return F.regexp_replace(c, r"^[^+]*\+", "")


def family_key(c: Column) -> Column:
    """A font's family: cut at the first dash, digits at the end dropped, upper case."""
    name = without_subset_prefix(c)
    key = F.regexp_replace(F.substring_index(name, "-", 1), r"[0-9]+$", "")
    return F.upper(F.when(key == "", name).otherwise(key))


def collapse_blank_lines(c: Column) -> Column:
    """Four newlines or more become three."""
    return F.regexp_replace(c, r"\n{4,}", "\n\n\n")


def escape_currency(c: Column) -> Column:
    r"""A dollar before a digit gets a backslash if it has an even number of them, line by line;
    lines that start as mathematics (``$``, ``\(``, ``\[``) stay."""

    def line(x: Column) -> Column:
        escaped = F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\$(?=\d)", r"$1\\\$")
        return F.when(F.ltrim(x).rlike(r"^(\$|\\\(|\\\[)"), x).otherwise(escaped)

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


MARKER = r"^%% === Page (\d+) ===$"


def without_markers(c: Column) -> Column:
    """Page-marker lines removed."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~F.trim(x).rlike(MARKER)), "\n")
