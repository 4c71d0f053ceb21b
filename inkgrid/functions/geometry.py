"""Geometry of boxes, lines and paths as native column expressions.

The y axis points up.  A box or line is four double columns; `Box.of(prefix)` names them.  Nothing here is a Python UDF, so
every expression stays inside generated code and its inputs are pruned at the scan.  Sources give every box four coordinates;
the line of a node that has none is four nulls, and what is derived from it is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slopes are clamped to this, and a shorter run than this counts as vertical.
MAX_SLOPE, VERTICAL_RUN = 1000.0, 0.001
#: Fixed value: how far outside a line's box an intersection may lie.
NEAR_LINE = 0.1
#: Fixed value: a box narrower than this has the largest ratio of height to width.
MIN_WIDTH = 0.1


@dataclass(frozen=True)
class Box:
    """Four coordinate columns: a bounding box, or a line from (x0, y0) to (x1, y1)."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    def axis(self, vertical: bool) -> tuple[Column, Column]:
        """(low, high) ends on one axis."""
        a, b = (self.y0, self.y1) if vertical else (self.x0, self.x1)
        return F.least(a, b), F.greatest(a, b)

    def grown(self, by: Column | float) -> Box:
        by = F.lit(by) if isinstance(by, (int, float)) else by
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def struct(self) -> Column:
        return F.struct(self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1"))


# boxes


def perimeter(b: Box) -> Column:
    return 2 * (b.width + b.height)


def midpoint(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2


def zeroed(b: Box, corner: Box) -> Box:
    """b moved so that the corner's (x0, y0) is the origin."""
    return Box(b.x0 - corner.x0, b.y0 - corner.y0, b.x1 - corner.x0, b.y1 - corner.y0)


def shared(a: Box, b: Box) -> Box:
    """The box that two boxes share; with x1 < x0 or y1 < y0 where they are apart."""
    (a_low, a_high), (b_low, b_high) = a.axis(True), b.axis(True)
    return Box(F.greatest(a.x0, b.x0), F.greatest(a_low, b_low), F.least(a.x1, b.x1), F.least(a_high, b_high))


def shared_area(s: Box) -> Column:
    """Area of a shared box; one without width or height counts a tenth of its (signed) length, none 0."""
    return F.when((s.x0 < s.x1) & (s.y0 < s.y1), s.width * s.height).when(s.x0 == s.x1, 0.1 * s.height).when(s.y0 == s.y1, s.width * 0.1).otherwise(0.0)


def overlap_area(a: Box, b: Box) -> Column:
    """Area of the overlap; boxes that only meet in a line count a tenth of its (signed) length, others 0."""
    return shared_area(shared(a, b))


def gap(a: Box, b: Box, vertical: bool) -> Column:
    """Distance of two intervals on an axis, 0 where they meet."""
    (a_low, a_high), (b_low, b_high) = a.axis(vertical), b.axis(vertical)
    return F.greatest(F.lit(0.0), a_low - b_high, b_low - a_high)


def overlap(a: Box, b: Box, vertical: bool) -> Column:
    """Length that two intervals share on an axis."""
    (a_low, a_high), (b_low, b_high) = a.axis(vertical), b.axis(vertical)
    return F.greatest(F.lit(0.0), F.least(a_high, b_high) - F.greatest(a_low, b_low))


def root(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(a: Box, b: Box) -> Column:
    return root(gap(a, b, False), gap(a, b, True))


def midpoint_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = midpoint(a), midpoint(b)
    return root(ax - bx, ay - by)


def quadrant(dx: Column, dy: Column) -> Column:
    """0 to 3, counter-clockwise from right and up."""
    return F.when((dx >= 0) & (dy >= 0), 0).when((dx < 0) & (dy >= 0), 1).when((dx < 0) & (dy < 0), 2).otherwise(3)


def height_to_width(width: Column, height: Column) -> Column:
    return F.when(width <= MIN_WIDTH, F.lit(MAX_SLOPE)).otherwise(F.least(F.lit(MAX_SLOPE), height / width))


def flipped(b: Box, page_height: Column) -> Box:
    """Between y up and y down."""
    return Box(b.x0, page_height - b.y1, b.x1, page_height - b.y0)


def rounded_out(b: Box) -> Box:
    return Box(F.floor(b.x0), F.floor(b.y0), F.ceil(b.x1), F.ceil(b.y1))


def truncated(b: Box) -> Box:
    return Box(*(c.cast("int") for c in (b.x0, b.y0, b.x1, b.y1)))


def cell(x: Column, step: float) -> Column:
    """Number of the grid cell that holds x; floors negative values too."""
    return F.floor(x / F.lit(float(step))).cast("int")


# lines


def slope(line: Box) -> Column:
    run, rise = line.x1 - line.x0, line.y1 - line.y0
    steep = F.when(run >= 0, F.lit(MAX_SLOPE)).otherwise(F.lit(-MAX_SLOPE))
    return F.when(F.abs(run) < VERTICAL_RUN, steep).otherwise(F.greatest(F.lit(-MAX_SLOPE), F.least(F.lit(MAX_SLOPE), rise / run)))


def direction(dx: Column, dy: Column) -> Column:
    """Degrees in (-180, 180], right is 0."""
    return F.degrees(F.atan2(dy, dx))


def angle(line: Box) -> Column:
    return direction(line.x1 - line.x0, line.y1 - line.y0)


def angle_between(a: Column, b: Column, directed: bool) -> Column:
    """Difference of two angles in 0 to 180; undirected lines may be turned round."""

    def folded(x: Column, y: Column) -> Column:
        d = F.abs(x - y)
        return F.when(d > 180, 360 - d).otherwise(d)

    if directed:
        return folded(a, b)
    turned = F.when(a > 0, a - 180).otherwise(a + 180)
    return F.least(folded(a, b), folded(turned, b))


def length(line: Box) -> Column:
    return root(line.x1 - line.x0, line.y1 - line.y0)


def offset(a: Box, b: Box) -> tuple[Column, Column]:
    """From the start of a to the start of b."""
    return b.x0 - a.x0, b.y0 - a.y0


def determinant(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * d - b * c


def near_line(line: Box, x: Column, y: Column) -> Column:
    """Whether a point lies in the line's box, a tenth of a unit more."""
    (x_low, x_high), (y_low, y_high) = line.axis(False), line.axis(True)
    return x.between(x_low - NEAR_LINE, x_high + NEAR_LINE) & y.between(y_low - NEAR_LINE, y_high + NEAR_LINE)


def crossing_point(a: Box, b: Box) -> tuple[Column, Column, Column]:
    """(cross product of the directions, x, y) of two lines drawn on without end; x and y mean nothing where the first is 0."""
    adx, ady, bdx, bdy = a.x0 - a.x1, a.y0 - a.y1, b.x0 - b.x1, b.y0 - b.y1
    cross = determinant(adx, bdx, ady, bdy)
    da, db = determinant(a.x0, a.y0, a.x1, a.y1), determinant(b.x0, b.y0, b.x1, b.y1)
    safe = F.when(cross != 0, cross)
    return cross, determinant(da, db, adx, bdx) / safe, determinant(da, db, ady, bdy) / safe


def intersection(a: Box, b: Box) -> Column:
    """struct(x, y) where two lines meet near both of them; null for parallel lines or none."""
    cross, x, y = crossing_point(a, b)
    return F.when(cross != 0, F.when(near_line(a, x, y) & near_line(b, x, y), F.struct(x.alias("x"), y.alias("y"))))


def line_distance(a: Box, b: Box) -> Column:
    """Smaller of the two sums of coordinate differences of the ends, as drawn or with one line reversed."""
    forward = F.abs(a.x0 - b.x0) + F.abs(a.y0 - b.y0) + F.abs(a.x1 - b.x1) + F.abs(a.y1 - b.y1)
    backward = F.abs(a.x0 - b.x1) + F.abs(a.y0 - b.y1) + F.abs(a.x1 - b.x0) + F.abs(a.y1 - b.y0)
    return F.least(forward, backward)


def _box(line: Column) -> Box:
    return Box(line["x0"], line["y0"], line["x1"], line["y1"])


def line_set_distance(mine: Column, others: Column) -> Column:
    """Sum over my lines of the distance to the nearest other line, over the larger number of lines; not symmetric."""
    nearest = F.transform(mine, lambda a: F.array_min(F.transform(others, lambda b: line_distance(_box(a), _box(b)))))
    total = F.aggregate(nearest, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0)))
    return F.when((F.size(mine) == 0) | (F.size(others) == 0), 0.0).otherwise(total / F.greatest(F.size(mine), F.size(others)))


def line_activation(slope_a: Column, length_a: Column, slope_b: Column, length_b: Column) -> Column:
    """How alike two lines are in slope and length, at most 1."""
    by_slope = 1 - F.tanh(F.abs(slope_a - slope_b))
    by_length = 1 - F.tanh(F.abs(length_a - length_b) / F.greatest(length_a, length_b, F.lit(0.001)))
    return F.least(by_slope, by_length)


def text_activation(text_a: Column, size_a: Column, text_b: Column, size_b: Column, weight: float = 0.5) -> Column:
    """How alike two texts are: equality and size, weighed."""
    same = F.when(text_a == text_b, 1.0).otherwise(0.0)
    return weight * same + (1 - weight) * (1 - F.tanh(F.abs(size_a - size_b)))


def node_activations(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """array<struct<type, score>>: slope and length for two lines, text and orientation and size for two texts."""
    pair = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("score"))
    lines = F.array(pair("slope", 1 - F.abs(a["slope"] - b["slope"]) / MAX_SLOPE), pair("length", 1 - F.abs(a["length"] - b["length"]) / F.greatest(a["length"], b["length"], F.lit(0.001))))
    as_number = lambda c: F.when(c, 1.0).otherwise(0.0)
    texts = F.array(pair("text", as_number(a["text"] == b["text"])), pair("left_right", as_number(a["left_right"] == b["left_right"])), pair("size", 1 - F.tanh(F.abs(a["fontsize"] - b["fontsize"]))))
    return F.when(a["text"].isNull() & b["text"].isNull(), lines).when(a["text"].isNotNull() & b["text"].isNotNull(), texts)


def node_features(box: Box, line: Box, text: Column, upright: Column) -> dict[str, Column]:
    """Derived columns of a node: a glyph reads left to right if upright, a line if it is no steeper than 1."""
    steep = slope(line)
    is_line = line.x0.isNotNull()
    left_right = F.when(is_line, F.abs(steep) <= 1).otherwise(F.coalesce(upright, F.lit(True)))
    return {
        "left_right": left_right,
        "fontsize": F.when(text.isNotNull(), F.when(left_right, box.height).otherwise(box.width)),
        "slope": F.when(is_line, steep),
        "angle": F.when(is_line, angle(line)),
        "length": F.when(is_line, length(line)).otherwise(F.when(left_right, box.width).otherwise(box.height)),
    }


def node_angle(source: Box, source_line: Box, other: Box, other_line: Box) -> Column:
    """Direction from the middle of one node's line (or box) to the other's."""

    def middle(box: Box, line: Box) -> tuple[Column, Column]:
        (bx, by), (lx, ly) = midpoint(box), midpoint(line)
        return F.coalesce(lx, bx), F.coalesce(ly, by)

    (sx, sy), (ox, oy) = middle(source, source_line), middle(other, other_line)
    return direction(ox - sx, oy - sy)


def corner_angles(source: Box, other: Box) -> Column:
    """Directions between like corners of two boxes."""
    corners = lambda b: [(b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1)]
    return F.array(*[direction(ox - sx, oy - sy) for (sx, sy), (ox, oy) in zip(corners(source), corners(other), strict=True)])


def line_cells(line: Box, step: float) -> Column:
    """array<struct<cx, cy>>: the grid cells that a line passes, stepping along its longer axis."""
    dx, dy = line.x1 - line.x0, line.y1 - line.y0
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / step).cast("int"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(cell(line.x0 + dx * k / n, step).alias("cx"), cell(line.y0 + dy * k / n, step).alias("cy"))))


# paths: array<struct<op: string, pts: array<struct<x, y>>>>

LINE = "struct<x0: double, y0: double, x1: double, y1: double>"


def bezier_point(t: Column, pts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Point of a cubic curve at t."""
    u = 1 - t
    weights = (u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t)
    x, y = (sum((w * p[axis] for w, p in zip(weights[1:], pts[1:], strict=True)), weights[0] * pts[0][axis]) for axis in (0, 1))
    return x, y


def bezier_lines(pts: list[tuple[Column, Column]], chords: int = 10) -> Column:
    """array of the chords of a cubic curve, in drawing order."""

    def chord(k: Column) -> Column:
        (x0, y0), (x1, y1) = bezier_point((k - 1) / chords, pts), bezier_point(k / chords, pts)
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    return F.transform(F.sequence(F.lit(1), F.lit(chords)), chord)


def path_lines(path: Column) -> Column:
    """array of the lines of a path: m moves the pen, l draws, c draws chords, h closes without moving the pen.

    The pen starts at the origin.  Lines of l and h run from smaller to larger x; other operations draw nothing.
    """
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    origin = point(F.lit(0.0), F.lit(0.0))
    start = F.struct(origin.alias("pen"), origin.alias("first"), F.array().cast(f"array<{LINE}>").alias("lines"))

    def swapped(a: Column, b: Column) -> Column:
        keep = a["x"] <= b["x"]
        return F.struct(*[F.when(keep, p).otherwise(q).alias(n) for n, p, q in (("x0", a["x"], b["x"]), ("y0", a["y"], b["y"]), ("x1", b["x"], a["x"]), ("y1", b["y"], a["y"]))])

    def step(state: Column, s: Column) -> Column:
        op, pen, last = s["op"], state["pen"], F.element_at(s["pts"], -1)
        at = lambda k: (s["pts"][k]["x"], s["pts"][k]["y"])
        drawn = F.when(op == "l", F.array(swapped(pen, last))).when(op == "h", F.array(swapped(pen, state["first"]))).when(op == "c", bezier_lines([(pen["x"], pen["y"]), at(0), at(1), at(2)])).otherwise(F.array().cast(f"array<{LINE}>"))
        moved = F.when(op.isin("m", "l", "c"), point(last["x"], last["y"])).otherwise(pen)
        first = F.when(op == "m", point(last["x"], last["y"])).otherwise(state["first"])
        return F.struct(moved.alias("pen"), first.alias("first"), F.concat(state["lines"], drawn).alias("lines"))

    return F.aggregate(path, start, step, lambda s: s["lines"])


def lines_box(lines: Column) -> Column:
    """struct: the box of an array of lines; (0, 0, 1, 1) for none."""
    ends = lambda a, b: F.concat(F.transform(lines, lambda v: v[a]), F.transform(lines, lambda v: v[b]))
    corner = lambda c, name, empty: F.coalesce(c, F.lit(empty)).alias(name)
    return F.struct(corner(F.array_min(ends("x0", "x1")), "x0", 0.0), corner(F.array_min(ends("y0", "y1")), "y0", 0.0), corner(F.array_max(ends("x0", "x1")), "x1", 1.0), corner(F.array_max(ends("y0", "y1")), "y1", 1.0))


def zeroed_lines(lines: Column) -> Column:
    """The lines moved so that their smallest x and y are 0."""
    box = lines_box(lines)
    return F.transform(lines, lambda v: F.struct((v["x0"] - box["x0"]).alias("x0"), (v["y0"] - box["y0"]).alias("y0"), (v["x1"] - box["x0"]).alias("x1"), (v["y1"] - box["y0"]).alias("y1")))


def curve_size(path: Column, box: Box) -> Column:
    """Area of the box of a path with a curve in it, else 0."""
    return F.when(F.exists(path, lambda s: s["op"] == "c"), box.width * box.height).otherwise(0.0)


def pairwise_offsets(lines: Column) -> Column:
    """array of arrays: from each line's start to every line's start."""
    return F.transform(lines, lambda a: F.transform(lines, lambda b: F.struct((b["x0"] - a["x0"]).alias("dx"), (b["y0"] - a["y0"]).alias("dy"))))
