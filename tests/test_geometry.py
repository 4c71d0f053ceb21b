from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry as g
from inkgrid.functions import predicates as p
from inkgrid.functions import texts as t
from inkgrid.functions.geometry import Box


def lit_box(*v) -> Box:
    return Box(*[F.lit(None if x is None else float(x)).cast("double") for x in v])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("line, slope", [((0, 0, 1, 2), 2.0), ((0, 0, 0, 5), 1000.0), ((0, 5, 0, 0), 1000.0), ((0.0005, 0, 0, 5), -1000.0), ((0, 0, 0.01, 50), 1000.0), ((2, 0, 0, 4), -2.0)])
def test_slope(spark, line, slope):
    assert value(spark, g.slope(lit_box(*line))) == slope


def test_overlap_area_signs(spark):
    assert value(spark, g.overlap_area(lit_box(0, 0, 2, 2), lit_box(1, 1, 3, 3))) == 1.0
    assert value(spark, g.overlap_area(lit_box(0, 0, 2, 2), lit_box(2, 0, 3, 1))) == pytest.approx(0.1)
    assert value(spark, g.overlap_area(lit_box(0, 0, 2, 2), lit_box(2, 5, 3, 6))) == pytest.approx(-0.3)
    assert value(spark, g.overlap_area(lit_box(0, 0, 2, 2), lit_box(5, 5, 6, 6))) == 0.0


def test_angles(spark):
    assert value(spark, g.angle_between(F.lit(170.0), F.lit(-170.0), True)) == pytest.approx(20)
    assert value(spark, g.angle_between(F.lit(0.0), F.lit(180.0), False)) == pytest.approx(0)
    assert value(spark, g.angle(lit_box(0, 0, 0, 1))) == pytest.approx(90)
    assert value(spark, p.in_direction(F.lit(-178.0), F.lit(178.0), 10.0, intended=True))
    assert not value(spark, p.in_direction(F.lit(-178.0), F.lit(178.0), 10.0))


def test_intersection(spark):
    assert tuple(value(spark, g.intersection(lit_box(0, 0, 4, 4), lit_box(0, 4, 4, 0)))) == (2.0, 2.0)
    assert value(spark, g.intersection(lit_box(0, 0, 1, 0), lit_box(0, 1, 1, 1))) is None
    assert tuple(value(spark, g.intersection(lit_box(-4, -4, -2, -2), lit_box(-4, -2, -2, -4)))) == (-3.0, -3.0)


def test_path_lines(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    step = lambda op, *pts: F.struct(F.lit(op).alias("op"), (F.array(*[point(*q) for q in pts]) if pts else F.array().cast("array<struct<x: double, y: double>>")).alias("pts"))
    lines = value(spark, g.path_lines(F.array(step("m", (5, 5)), step("l", (1, 2)), step("l", (3, 3)), step("h"), step("l", (9, 9)))))
    assert [tuple(v) for v in lines] == [(1, 2, 5, 5), (1, 2, 3, 3), (3, 3, 5, 5), (3, 3, 9, 9)]
    curve = value(spark, g.path_lines(F.array(step("m", (0, 0)), step("c", (0, 1), (1, 1), (1, 0)))))
    assert len(curve) == 10 and tuple(curve[-1])[2:] == pytest.approx((1, 0))
    assert value(spark, g.path_lines(F.array(step("?", (1, 1))))) == []
    assert tuple(value(spark, g.lines_box(F.array().cast(f"array<{g.LINE}>")))) == (0, 0, 1, 1)


def test_line_sets(spark):
    line = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"))])
    a, b = F.array(line(0, 0, 1, 1)), F.array(line(1, 1, 0, 0), line(5, 5, 6, 6))
    assert value(spark, g.line_set_distance(a, a)) == 0
    assert value(spark, g.line_set_distance(a, b)) == 0
    assert value(spark, g.line_set_distance(b, a)) == pytest.approx(10)
    assert value(spark, g.line_set_distance(a, F.array().cast(f"array<{g.LINE}>"))) == 0
    assert value(spark, g.line_activation(F.lit(1.0), F.lit(5.0), F.lit(1.0), F.lit(5.0))) == 1.0
    assert value(spark, g.line_activation(F.lit(1.0), F.lit(5.0), F.lit(2.0), F.lit(5.0))) == pytest.approx(1 - math.tanh(1))


def test_small_expressions(spark):
    b = lit_box(1, 2, 4, 8)
    assert value(spark, g.perimeter(b)) == 18
    assert value(spark, g.height_to_width(F.lit(0.05), F.lit(3.0))) == 1000
    assert value(spark, g.cell(F.lit(-0.5), 5)) == -1
    assert tuple(value(spark, g.flipped(b, F.lit(10.0)).struct())) == (1, 2, 4, 8)
    assert [tuple(c) for c in value(spark, g.line_cells(lit_box(0, 0, 10, 0), 5))] == [(0, 0), (1, 0), (2, 0)]
    assert value(spark, g.quadrant(F.lit(-1.0), F.lit(1.0))) == 1
    assert len(value(spark, g.corner_angles(b, lit_box(5, 5, 6, 6)))) == 4
    assert value(spark, p.line_kind(lit_box(0, 0, 0, 5))) == "vertical"
    assert value(spark, p.bounded(Box(F.lit(None).cast("double"), *[F.lit(v) for v in (0.0, 9.0, 9.0)]), b))
    assert value(spark, p.positioned(lit_box(0, 0, 1, 1), lit_box(2, 0, 3, 1), False, True, F.lit(False)))
    assert value(spark, p.circle_like(F.array(*[F.lit(15.0 * k) for k in range(8)])))
    assert not value(spark, p.circle_like(F.array(*[F.lit(30.0 * k) for k in range(8)])))


LABELS = [("1.5", {1, 2}), ("3/4", {1, 3}), ("12", {1, 4}), ("feet", {5, 6}), ('"', {5, 7}), ('3"', set()), ("12\n", set()), ("x", set()), ("/", {8}), ("12 feet", set())]


@pytest.mark.parametrize("text, labels", LABELS)
def test_labels(spark, text, labels):
    assert set(value(spark, t.label_map(F.lit(text)))) == labels


def test_texts(spark):
    assert value(spark, t.normal_key(F.lit("\n Door\nSchedule "))) == "door schedule"
    assert value(spark, t.letter_code(F.lit("c"))) == 3 and value(spark, t.letter_code(F.lit("0"))) == 27
    assert value(spark, t.is_window_key(F.lit("A12"))) and not value(spark, t.is_window_key(F.lit("A123")))
    node = lambda text, bar=False: F.struct(F.lit(text).cast("string").alias("text"), F.lit(bar).alias("is_line"), F.lit(1.0).alias("slope"), F.lit(5.0).alias("length"))
    assert value(spark, t.joined_text(F.array(node("3"), node(None, True), node("4")))) == "3/4"
    assert value(spark, t.joined_text(F.array(node("3"), node(None, True), node('"')))) == '3"'
    assert value(spark, t.joined_text(F.array(node(None, True)))) == ""
    assert value(spark, t.bounds_text([F.lit(1.0), F.lit(None).cast("double")])) == "(1.00,-1)"
    assert value(spark, t.text_code(F.lit("ab"))) == 21
