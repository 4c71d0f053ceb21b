"""Predicates over boxes, lines and texts, as native boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import MAX_SLOPE, Box, angle_between, gap, overlap


def contains(outer: Box, inner: Box) -> Column:
    """Closed containment."""
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1)


def intersects(a: Box, b: Box) -> Column:
    """Closed overlap."""
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def bounded(bounds: Box, b: Box) -> Column:
    """Containment in bounds of which any side may be null, that is open."""
    side = lambda c: F.coalesce(c, F.lit(True))
    return side(bounds.x0 <= b.x0) & side(bounds.y0 <= b.y0) & side(bounds.x1 >= b.x1) & side(bounds.y1 >= b.y1)


def top_left_inside(outer: Box, b: Box) -> Column:
    return b.x0.between(outer.x0, outer.x1) & b.y1.between(outer.y0, outer.y1)


def line_kind(b: Box, tolerance: float = 0.1) -> Column:
    """vertical, horizontal or none, by the extent of a box."""
    return F.when(F.abs(b.width) < tolerance, "vertical").when(F.abs(b.height) < tolerance, "horizontal").otherwise("none")


def is_vertical(b: Box) -> Column:
    """At most a unit wide, and higher than nine tenths of that."""
    return (b.width <= 1) & (b.height / (b.width + 0.1) > 0.9)


def is_horizontal(b: Box) -> Column:
    return (b.height <= 1) & (b.height / (b.width + 0.1) < 0.1)


def rows_meet(a: Box, b: Box) -> Column:
    """The y intervals meet."""
    return (a.y0 <= b.y1) & (b.y0 <= a.y1)


def aligned(a: Box, b: Box, vertical: bool) -> Column:
    """No gap across the direction."""
    return gap(a, b, not vertical) == 0


def not_before(a: Box, b: Box, vertical: bool) -> Column:
    """b lies after a on the axis, or reaches from within a to beyond it."""
    (a0, a1), (b0, b1) = a.axis(vertical), b.axis(vertical)
    return (b0 >= a1) | ((b0 >= a0) & (b1 >= a1))


def not_after(a: Box, b: Box, vertical: bool) -> Column:
    (a0, a1), (b0, b1) = a.axis(vertical), b.axis(vertical)
    return (b1 <= a0) | ((b1 <= a1) & (b0 <= a0))


def positioned(a: Box, b: Box, vertical: bool, after: bool, lines: Column) -> Column:
    """b after (or before) a: for lines loosely, for texts wholly beyond the box."""
    loose = not_before(a, b, vertical) if after else not_after(a, b, vertical)
    a0, a1 = (a.y0, a.y1) if vertical else (a.x0, a.x1)
    b0, b1 = (b.y0, b.y1) if vertical else (b.x0, b.x1)
    strict = b0 >= a1 if after else b1 <= a0
    return F.when(lines, loose).otherwise(strict)


def in_direction(relative: Column, angle: Column, threshold: float, intended: bool = False) -> Column:
    """An angle is within the threshold of another.

    As the engine to match has it, a second window, centred a threshold further from 0, counts too; intended takes
    one window that wraps around instead.
    """
    if intended:
        return angle_between(relative, angle, True) < threshold
    wider = F.when(angle < 0, -(F.abs(angle) + threshold)).otherwise(F.abs(angle) + threshold)
    return (F.abs(relative - angle) < threshold) | (F.abs(relative - wider) < threshold)


def joins_word(a: Box, b: Box, left_right: Column, size_a: Column, size_b: Column, text_b: Column, other_left_right: Column, fraction_a: Column | None = None, allow_space: bool = False, radius: float = 1.0) -> Column:
    """b continues the word of a: same reading direction and size, same line, touching ends (or centred on a fraction)."""
    same = (left_right == other_left_right) & (F.abs(size_b - size_a) <= 1)
    if not allow_space:
        same = same & (text_b != " ")
    across = F.when(left_right, overlap(a, b, True)).otherwise(overlap(a, b, False))
    start = F.when(left_right, a.height).otherwise(a.width)
    a0, a1 = F.when(left_right, a.x0).otherwise(a.y0), F.when(left_right, a.x1).otherwise(a.y1)
    b0, b1 = F.when(left_right, b.x0).otherwise(b.y0), F.when(left_right, b.x1).otherwise(b.y1)
    touching = (F.abs(b1 - a0) < radius) | (F.abs(b0 - a1) < radius)
    level = F.abs(across - start) <= 1
    if fraction_a is None:
        return same & level & touching
    centred = (across / start > 0.25) & (((a0 < b0) & (a1 > b1)) | ((a0 > b0) & (a1 < b1)))
    return same & F.when(level, touching).otherwise(fraction_a & centred)


def joins_fraction(a: Box, b: Box, left_right: Column, other_left_right: Column, either_fraction: Column) -> Column:
    """A text joins a fraction, or a fraction a text: they overlap by a quarter across, one centred in the other."""
    across = F.when(left_right, overlap(a, b, True)).otherwise(overlap(a, b, False))
    start = F.when(left_right, a.height).otherwise(a.width)
    a0, a1 = F.when(left_right, a.y0).otherwise(a.x0), F.when(left_right, a.y1).otherwise(a.x1)
    b0, b1 = F.when(left_right, b.y0).otherwise(b.x0), F.when(left_right, b.y1).otherwise(b.x1)
    centred = ((a0 < b0) & (a1 > b1)) | ((a0 > b0) & (a1 < b1))
    return (left_right == other_left_right) & either_fraction & (across / start > 0.25) & centred


def divider_like(divider_length: Column, width: Column, height: Column) -> Column:
    """A fraction bar about as long as a number is large."""
    size = F.greatest(width, height)
    return F.abs(divider_length - size) < size


def vertical_divider(slope: Column, line_length: Column, height: Column) -> Column:
    """A bar between numbers of turned text."""
    return (F.abs(line_length - height) < height) & (F.abs(F.abs(slope) - MAX_SLOPE) < 10)


def in_title_corner(b: Box, page_width: Column, page_height: Column) -> Column:
    """Where drawings carry the name of the house: far right and low."""
    return (b.x0 / page_width >= 0.8) & (b.y0 / page_height <= 0.4)


def circle_like(angles: Column, most: float = 20.0) -> Column:
    """An array of line angles turns by no more than `most` degrees between neighbours; the closing turn is not tested."""
    later, earlier = F.slice(angles, 2, F.size(angles)), F.slice(angles, 1, F.size(angles) - 1)
    turns = F.zip_with(earlier, later, lambda x, y: angle_between(x, y, False))
    return (F.size(angles) < 2) | F.forall(turns, lambda d: d <= most)
