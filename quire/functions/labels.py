"""Page labels: roman numerals, label parsing and zero-padded names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the roman digits, largest first.
ROMAN = (
    (1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"),
)
LARGEST = 2147483647
#: No numeral of more letters is canonical up to LARGEST thousands worth writing; the same bound in both label parsers.
LONGEST = 64


def roman(n: Column) -> Column:
    """Lower-case roman numeral of a positive number."""
    out, rest = F.lit(""), n.cast("bigint")
    for value, digits in ROMAN:
        out = F.concat(out, F.repeat(F.lit(digits), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return out


def roman_value(c: Column) -> Column:
    """Value of a lower-case roman numeral: a digit before a larger one counts negative."""
    digit = F.create_map(*[x for v, d in ROMAN if len(d) == 1 for x in (F.lit(d), F.lit(v).cast("bigint"))])
    values = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.coalesce(digit[x], F.lit(0).cast("bigint")))
    following = F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0).cast("bigint")))
    signed = F.zip_with(values, following, lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)


def parse_label(c: Column) -> Column:
    """``struct<style, value>`` of a printed page label, or null.

    ASCII digits are arabic; a roman numeral in one case counts only in its
    canonical spelling, which is what writing its value again yields.
    """
    digits = F.regexp_extract(c, r"^0*([0-9]{1,10})$", 1)
    number = F.when((digits != "") & (digits.cast("bigint") <= LARGEST), digits.cast("bigint"))
    low = F.lower(c)
    letters = c.rlike(r"^([ivxlcdm]+|[IVXLCDM]+)$") & (F.length(c) <= LONGEST)
    value = F.when(letters, roman_value(low))
    canonical = letters & (roman(value) == low)
    style = F.when(number.isNotNull(), "arabic").when(canonical & (c == low), "roman").when(canonical, "Roman")
    return F.when(style.isNotNull(), F.struct(style.alias("style"), F.coalesce(number, value).alias("value")))


def page_file(n: Column) -> Column:
    return F.format_string("page-%04d", n)


def block_id(page: Column, n: Column) -> Column:
    return F.format_string("p%04d-b%04d", page, n)


def chapter_id(n: Column) -> Column:
    return F.format_string("ch%02d", n)


def figure_file(page: Column, fig_id: Column) -> Column:
    """A figure's file name: its safe id in lower case under the page's prefix, or null."""
    low, prefix = F.lower(fig_id), F.format_string("p%03d-", page)
    return F.when(fig_id.rlike("^[0-9A-Za-z._-]+$"), F.when(F.startswith(low, prefix), low).otherwise(F.concat(prefix, low)))
