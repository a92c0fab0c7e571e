"""Page and box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paper classes by width and height in millimetres, in the order they are tried.
PAPERS = (("letterpaper", 215.9, 279.4), ("a4paper", 210.0, 297.0), ("legalpaper", 215.9, 355.6), ("b5paper", 176.0, 250.0))
MM_PER_PT = 25.4 / 72.0


def swaps_sides(rotation: Column) -> Column:
    return F.pmod(rotation, F.lit(360)).isin(90, 270)


def displayed(width: Column, height: Column, rotation: Column) -> Column:
    swap = swaps_sides(rotation)
    return F.struct(F.when(swap, height).otherwise(width).alias("width"), F.when(swap, width).otherwise(height).alias("height"))


def pixels(points: Column, dpi: Column) -> Column:
    """Pixels that a length needs at a resolution, one at least."""
    return F.greatest(F.ceil(points * dpi / 72.0), F.lit(1).cast("bigint"))


def paper_class(width: Column, height: Column, tolerance: float = 3.0) -> Column:
    """The first paper within the tolerance on both sides, or ``custom``."""
    out = F.when(F.lit(False), "")
    for name, w, h in PAPERS:
        out = out.when((F.abs(width * MM_PER_PT - w) <= tolerance) & (F.abs(height * MM_PER_PT - h) <= tolerance), name)
    return out.otherwise("custom")


def a4_class(width: Column, height: Column) -> Column:
    """exactA4, nearA4 (1.5 points on each side) or other, in either orientation. The exact tolerance, 0.01, is our choice."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    off = F.greatest(F.abs(short - 210 / MM_PER_PT), F.abs(long_ - 297 / MM_PER_PT))
    return F.when(off <= 0.01, "exactA4").when(off <= 1.5, "nearA4").otherwise("other")


def valid_bbox(b: Column) -> Column:
    """Four finite numbers: a non-empty box inside the unit square."""
    finite = F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    inside = (b[0] >= 0) & (b[1] >= 0) & (b[2] > 0) & (b[3] > 0) & (b[0] + b[2] <= 1 + 1e-6) & (b[1] + b[3] <= 1 + 1e-6)
    return F.coalesce(F.when((F.size(b) == 4) & finite, inside), F.lit(False))


def padded(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, by: float) -> Column:
    """A box grown on every side and cut at the page."""
    lo_x, lo_y = F.greatest(F.lit(0.0), x - by), F.greatest(F.lit(0.0), y - by)
    hi_x, hi_y = F.least(page_w, x + w + by), F.least(page_h, y + h + by)
    return F.struct(lo_x.alias("x"), lo_y.alias("y"), (hi_x - lo_x).alias("width"), (hi_y - lo_y).alias("height"))


def crop_rectangle(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, image_w: Column, image_h: Column) -> Column:
    """Pixels of a box given from the bottom left, in an image counted from the top left."""
    sx, sy = image_w / page_w, image_h / page_h
    left, top = F.greatest(F.floor(x * sx), F.lit(0)), F.greatest(F.floor((page_h - y - h) * sy), F.lit(0))
    right, bottom = F.least(F.ceil((x + w) * sx), image_w), F.least(F.ceil((page_h - y) * sy), image_h)
    return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter length; 0 where that isn't positive."""
    base = F.least(a1 - a0, b1 - b0)
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(base > 0, shared / base).otherwise(0.0)


def chars_per_line(paper_pt: Column, left_in: Column, right_in: Column, body_pt: Column) -> Column:
    """Characters that fit the text width: an average character is 0.48 of the size wide."""
    return ((paper_pt - (left_in + right_in) * 72.0) / (body_pt * 0.48)).cast("int")


def uniform_margins(*sides: Column) -> Column:
    return F.greatest(*sides) - F.least(*sides) < 0.15
