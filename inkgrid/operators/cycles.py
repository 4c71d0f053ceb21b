"""Closed outlines: circles and hexagons among connected lines of a page."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, stored
from .spatial import BOX, copies, line_crossings

Point = tuple[float, float]
Line = tuple[float, float, float, float]

#: Turn of a circle's neighbouring lines, tolerance of a hexagon's turns, of ends that meet.
TURN, SUM_OFF, END_OFF = 20.0, 1.0, 0.01


def _angle(line: Line) -> float:
    return math.degrees(math.atan2(line[3] - line[1], line[2] - line[0]))


def _turn(a: float, b: float, directed: bool) -> float:
    d = abs(a - b) % 360
    d = min(d, 360 - d)
    return d if directed else min(d, 180 - d)


def is_circle(lines: list[Line]) -> bool:
    """More than five lines, neighbours turning by no more than TURN; the closing turn is not tested."""
    angles = [_angle(x) for x in lines]
    return len(lines) > 5 and all(_turn(a, b, False) <= TURN for a, b in zip(angles, angles[1:]))


def is_hexagon(lines: list[Line]) -> bool:
    """Six lines, walked end to end, whose turns add up to a full circle."""
    if len(lines) != 6:
        return False
    at, now, total = lines[0][2:], _angle(lines[0]), 0.0
    for line in [*lines[1:], lines[0]]:
        forward = abs(line[0] - at[0]) < END_OFF and abs(line[1] - at[1]) < END_OFF
        walked = line if forward else (*line[2:], *line[:2])
        nxt = _angle(walked)
        total, now, at = total + _turn(now, nxt, True), nxt, walked[2:]
    return abs(total - 360) < SUM_OFF


def fundamental_cycles(lines: dict[int, Line]) -> list[list[int]]:
    """One cycle for each line that a spanning forest leaves out: that line first, then the way back from its end to its start.

    Trees grow breadth first from the smallest end point of each connected drawing; a point's parent line is the smallest one that
    leads to the level before.  Each point keeps its parent only, so memory follows the lines and time the cycles' lengths.
    Lines without length are left out.
    """
    at: dict[Point, list[int]] = defaultdict(list)
    for k in sorted(lines):
        x0, y0, x1, y1 = lines[k]
        if (x0, y0) != (x1, y1):
            at[x0, y0].append(k)
            at[x1, y1].append(k)

    def other(k: int, v: Point) -> Point:
        return lines[k][2:] if lines[k][:2] == v else lines[k][:2]

    level: dict[Point, int] = {}
    parent: dict[Point, int] = {}
    for root in sorted(at):
        if root in level:
            continue
        level[root], ring = 0, [root]
        while ring:
            reached: dict[Point, int] = {}
            for v in ring:
                for k in at[v]:
                    w = other(k, v)
                    if w not in level:
                        reached[w] = min(k, reached.get(w, k))
            for w, k in reached.items():
                level[w], parent[w] = level[ring[0]] + 1, k
            ring = list(reached)
    tree = set(parent.values())
    found = []
    for k in sorted(lines):
        start, end = lines[k][:2], lines[k][2:]
        if k in tree or start == end:
            continue
        up, down = [k], []
        while start != end:
            if level[end] >= level[start]:
                up.append(parent[end])
                end = other(parent[end], end)
            else:
                down.append(parent[start])
                start = other(parent[start], start)
        found.append(up + down[::-1])
    return found


def drawings(segments: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """Segments with `drawing`: equal for lines of a page that are connected through end points that they share."""
    end = lambda x, y: F.xxhash64(*by, F.col(x) + F.lit(0.0), F.col(y) + F.lit(0.0))
    ends = segments.withColumn("_a", end("x0", "y0"))
    named = components(ends.select(F.col("_a").alias("a"), end("x1", "y1").alias("b")))
    return ends.join(named.select(F.col("node").alias("_a"), F.col("component").alias("drawing")), "_a").drop("_a")


def outlines(segments: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """(page, kind, n, ids, box): circles and hexagons among the cycles of each page.

    Pages are split into connected drawings, which are dealt over tasks; a drawing is searched in one.
    """
    by = list(by)
    tasks = 4 * int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own_rows in rows.groupby([*by, "drawing"], sort=True):
            lines = dict(zip(own_rows.id.tolist(), own_rows[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None), strict=True))
            for cycle in fundamental_cycles(lines):
                own = [lines[k] for k in cycle]
                for kind, fits in (("circle", is_circle(own)), ("hexagon", is_hexagon(own))):
                    if fits:
                        xs, ys = [x for line in own for x in line[::2]], [y for line in own for y in line[1::2]]
                        out.append((*key[:-1], kind, len(cycle), sorted(cycle), min(xs), min(ys), max(xs), max(ys)))
        return pd.DataFrame(out, columns=[*by, "kind", "n", "ids", "x0", "y0", "x1", "y1"])

    types = dict(segments.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", kind string, n int, ids array<bigint>, x0 double, y0 double, x1 double, y1 double"
    found = drawings(segments.select(*by, "id", "x0", "y0", "x1", "y1"), by)
    return found.groupBy(F.pmod(F.xxhash64("drawing"), F.lit(tasks))).applyInPandas(search, schema)


def cut_at_crossings(segments: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, id, piece, x0, y0, x1, y1): segments cut where others cross or touch them, pieces numbered from their start.

    Points are rounded to six digits, so that the pieces that meet in one share it; pieces without length are dropped.
    """
    on = list(on)
    # copies are cut alike: different segments are cut once, under their smallest id
    own = stored(copies(segments.select(*on, "id", *BOX), on), "segments")
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    met = line_crossings(own.select(*on, "id", *BOX), on)
    met = met.select(*on, F.explode(F.array("a_id", "b_id")).alias("id"), F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("p"))
    points = met.unionByName(own.select(*on, "id", F.explode(ends).alias("p")))
    points = points.select(*on, "id", *[(F.round(f"p.{c}", 6) + F.lit(0.0)).alias(f"p{c}") for c in ("x", "y")]).distinct()
    placed = points.join(own, [*on, "id"])
    along = (F.col("px") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("py") - F.col("y0")) * (F.col("y1") - F.col("y0"))
    order = Window.partitionBy(*on, "id").orderBy(along, "px", "py")
    pieces = placed.select(*on, "ids", F.lag("px").over(order).alias("x0"), F.lag("py").over(order).alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"), (F.row_number().over(order) - 1).cast("bigint").alias("piece"))
    return pieces.filter(F.col("x0").isNotNull()).select(*on, F.explode("ids").alias("id"), "piece", "x0", "y0", "x1", "y1")


def unused_lines(segments: DataFrame, found: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """Segments that no outline uses."""
    return segments.join(found.select(*by, F.explode("ids").alias("id")).distinct(), [*by, "id"], "left_anti")
