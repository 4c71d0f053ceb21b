"""Queries that apply the scalar functions of geometry, predicates and texts to every row of a view, and their SQL.

A row of v_twins holds a line (x0 to y1) and a second one (bx0 to by1) derived from it; the boxes of both are compared too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import predicates as p
from ..functions import texts as t
from ..functions.geometry import Box
from .queries import query, r6
from .views import view


def _lines() -> tuple[Box, Box]:
    return Box.of(), Box.of("b")


def _box(line: Box) -> Box:
    (x0, x1), (y0, y1) = line.axis(False), line.axis(True)
    return Box(x0, y0, x1, y1)


def _slope(a: str) -> str:
    run, rise = f"({a}x1 - {a}x0)", f"({a}y1 - {a}y0)"
    return f"CASE WHEN abs({run}) < 0.001 THEN CASE WHEN {run} >= 0 THEN 1000.0::DOUBLE ELSE -1000.0::DOUBLE END ELSE greatest(-1000.0::DOUBLE, least(1000.0::DOUBLE, {rise} / {run})) END"


def _turn(x: str, y: str) -> str:
    return f"degrees(atan2({y}, {x}))"


def _length(a: str) -> str:
    return f"sqrt(({a}x1 - {a}x0) * ({a}x1 - {a}x0) + ({a}y1 - {a}y0) * ({a}y1 - {a}y0))"


#: The view's rows with the boxes (l for the line's, m for the twin's) and the angles of both.
BOXES = f""", q AS (SELECT *, least(x0, x1) AS lx0, least(y0, y1) AS ly0, greatest(x0, x1) AS lx1, greatest(y0, y1) AS ly1,
  least(bx0, bx1) AS mx0, least(by0, by1) AS my0, greatest(bx0, bx1) AS mx1, greatest(by0, by1) AS my1,
  {_turn("x1 - x0", "y1 - y0")} AS ta, {_turn("bx1 - bx0", "by1 - by0")} AS tb FROM v_twins)"""


def _fold(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} - {b}) > 180 THEN 360 - abs({a} - {b}) ELSE abs({a} - {b}) END"


TURNED = "(CASE WHEN ta > 0 THEN ta - 180 ELSE ta + 180 END)"
CORNERS = ", ".join(f"round({_turn(f'm{x} - l{x}', f'm{y} - l{y}')}, 6) + 0.0 AS corner{k}" for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
STEPS = "greatest(1, CAST(ceil(greatest(abs(x1 - x0), abs(y1 - y0)) / 5.0::DOUBLE) AS INTEGER))"


@query(
    f"""{BOXES}, c AS (SELECT *, list_distinct(list_transform(range(0, {STEPS} + 1), lambda k: {{'cx': CAST(floor((x0 + (x1 - x0) * k / {STEPS}) / 5.0::DOUBLE) AS INTEGER), 'cy': CAST(floor((y0 + (y1 - y0) * k / {STEPS}) / 5.0::DOUBLE) AS INTEGER)}})) AS cells FROM q)
    SELECT id, x0 - bx0 AS zeroed_x, y1 - by0 AS zeroed_y, CAST(sign(x1 - x0) AS INTEGER) AS run_sign, round({_fold("ta", "tb")}, 6) + 0.0 AS directed, round(least({_fold("ta", "tb")}, {_fold(TURNED, "tb")}), 6) + 0.0 AS undirected,
    bx0 - x0 AS dx, by0 - y0 AS dy, CASE WHEN bx0 - x0 >= 0 AND by0 - y0 >= 0 THEN 0 WHEN bx0 - x0 < 0 AND by0 - y0 >= 0 THEN 1 WHEN bx0 - x0 < 0 THEN 2 ELSE 3 END AS quadrant,
    round({_turn("(bx0 + bx1) / 2 - (x0 + x1) / 2", "(by0 + by1) / 2 - (y0 + y1) / 2")}, 6) + 0.0 AS node_angle, {CORNERS}, least(y0, y1) AS low, greatest(y0, y1) AS high,
    abs({_slope("")}) <= 1 AS left_right, round({_length("")}, 6) AS length, CAST(floor(x0 / 3) AS BIGINT) AS out_x0, CAST(ceil(y1 / 3) AS BIGINT) AS out_y1, CAST(trunc(y1 / 3) AS INTEGER) AS whole_y1,
    len(cells)::INTEGER AS n_cells, list_min(list_transform(cells, lambda v: v.cx)) AS first_cell, 800 - y1 AS flipped_y0,
    round(1 - abs(({_slope("")}) - ({_slope("b")})) / 1000.0::DOUBLE, 6) + 0.0 AS slope_score, round(1 - abs({_length("")} - {_length("b")}) / greatest({_length("")}, {_length("b")}, 0.001::DOUBLE), 6) + 0.0 AS length_score FROM c""",
    "v_twins",
)
def geometry_scalars(spark: SparkSession, sf: str) -> DataFrame:
    v, (line, twin) = view(spark, sf, "v_twins"), _lines()
    moved, (dx, dy), nothing = g.zeroed(line, twin), g.offset(line, twin), F.lit(None).cast("string")
    features, corners = g.node_features(_box(line), line, nothing, F.lit(True)), g.corner_angles(_box(line), _box(twin))
    third = Box(F.col("x0") / 3, F.col("y0") / 3, F.col("x1") / 3, F.col("y1") / 3)
    out, whole, cells = g.rounded_out(third), g.truncated(third), g.line_cells(line, 5.0)
    node = lambda b: {"slope": g.slope(b), "length": g.length(b), "text": nothing, "left_right": F.lit(True), "fontsize": F.lit(1.0)}
    scores = g.node_activations(node(line), node(twin))
    return v.select(
        "id", moved.x0.alias("zeroed_x"), moved.y1.alias("zeroed_y"), F.signum(line.width).cast("int").alias("run_sign"), r6(g.angle_between(g.angle(line), g.angle(twin), True)).alias("directed"), r6(g.angle_between(g.angle(line), g.angle(twin), False)).alias("undirected"),
        dx.alias("dx"), dy.alias("dy"), g.quadrant(dx, dy).alias("quadrant"), r6(g.node_angle(_box(line), line, _box(twin), twin)).alias("node_angle"), *[r6(corners[k]).alias(f"corner{k}") for k in range(4)], line.axis(True)[0].alias("low"), line.axis(True)[1].alias("high"),
        features["left_right"].alias("left_right"), r6(features["length"]).alias("length"), out.x0.alias("out_x0"), out.y1.alias("out_y1"), whole.y1.alias("whole_y1"), F.size(cells).alias("n_cells"), F.array_min(F.transform(cells, lambda c: c["cx"])).alias("first_cell"),
        g.flipped(line, F.lit(800.0)).y0.alias("flipped_y0"), r6(scores[0]["score"]).alias("slope_score"), r6(scores[1]["score"]).alias("length_score"),
    )


ACROSS = "greatest(0.0, least(ly1, my1) - greatest(ly0, my0))"
SAME = "(CASE WHEN id % 2 = 0 THEN TRUE ELSE id % 3 = 0 END) = (id % 2 = 0) AND abs(mx1 - mx0 - (lx1 - lx0)) <= 1"
WITHIN = "((lx0 < mx0 AND lx1 > mx1) OR (lx0 > mx0 AND lx1 < mx1))"
BESIDE = "((ly0 < my0 AND ly1 > my1) OR (ly0 > my0 AND ly1 < my1))"


@query(
    f"""{BOXES} SELECT id, (id % 3 = 0 OR lx0 <= mx0) AND ly0 <= my0 AND lx1 >= mx1 AND (id % 5 = 0 OR ly1 >= my1) AS bounded,
    CASE WHEN abs(lx1 - lx0) < 0.1 THEN 'vertical' WHEN abs(ly1 - ly0) < 0.1 THEN 'horizontal' ELSE 'none' END AS kind, ly0 <= my1 AND my0 <= ly1 AS meet,
    greatest(0.0, lx0 - mx1, mx0 - lx1) = 0 AS aligned_x, greatest(0.0, ly0 - my1, my0 - ly1) = 0 AS aligned_y, mx0 >= lx1 OR (mx0 >= lx0 AND mx1 >= lx1) AS not_before, my1 <= ly0 OR (my1 <= ly1 AND my0 <= ly0) AS not_after,
    CASE WHEN id % 2 = 0 THEN mx0 >= lx1 OR (mx0 >= lx0 AND mx1 >= lx1) ELSE mx0 >= lx1 END AS after_x, CASE WHEN id % 2 = 0 THEN my1 <= ly0 OR (my1 <= ly1 AND my0 <= ly0) ELSE my1 <= ly0 END AS before_y,
    lx0 / 600 >= 0.8 AND ly0 / 500 <= 0.4 AS corner, abs({_length("")} - greatest(mx1 - mx0, my1 - my0)) < greatest(mx1 - mx0, my1 - my0) AS divider, abs({_length("")} - (my1 - my0)) < my1 - my0 AND abs(abs({_slope("")}) - 1000) < 10 AS upright_divider,
    {SAME} AND CASE WHEN abs({ACROSS} - (ly1 - ly0)) <= 1 THEN abs(mx1 - lx0) < 30 OR abs(mx0 - lx1) < 30 ELSE id % 3 = 0 AND {ACROSS} / (ly1 - ly0) > 0.25 AND {WITHIN} END AS word,
    (CASE WHEN id % 2 = 0 THEN TRUE ELSE id % 3 = 0 END) = (id % 2 = 0) AND id % 7 <> 0 AND CASE WHEN id % 2 = 0 THEN {ACROSS} / (ly1 - ly0) > 0.25 AND {BESIDE} ELSE greatest(0.0, least(lx1, mx1) - greatest(lx0, mx0)) / (lx1 - lx0) > 0.25 AND {WITHIN} END AS fraction
    FROM q WHERE lx1 > lx0 AND ly1 > ly0""",
    "v_twins",
)
def predicate_scalars(spark: SparkSession, sf: str) -> DataFrame:
    v, (line, twin) = view(spark, sf, "v_twins"), _lines()
    a, b = _box(line), _box(twin)
    is_odd, third = F.col("id") % 2 != 0, F.col("id") % 3 == 0
    some = Box(F.when(~third, a.x0), a.y0, a.x1, F.when(F.col("id") % 5 != 0, a.y1))
    other = F.when(~is_odd, True).otherwise(third)
    # turned texts of the word test never meet, since their directions differ or the row's sizes do
    word = p.joins_word(a, b, F.lit(True), a.width, b.width, F.lit("x"), other == ~is_odd, fraction_a=third, radius=30.0)
    fraction = p.joins_fraction(a, b, ~is_odd, other, F.col("id") % 7 != 0)
    shown = v.filter((a.width > 0) & (a.height > 0))
    return shown.select(
        "id", p.bounded(some, b).alias("bounded"), p.line_kind(a).alias("kind"), p.rows_meet(a, b).alias("meet"), p.aligned(a, b, True).alias("aligned_x"), p.aligned(a, b, False).alias("aligned_y"), p.not_before(a, b, False).alias("not_before"), p.not_after(a, b, True).alias("not_after"),
        p.positioned(a, b, False, True, ~is_odd).alias("after_x"), p.positioned(a, b, True, False, ~is_odd).alias("before_y"), p.in_title_corner(a, F.lit(600.0), F.lit(500.0)).alias("corner"),
        p.divider_like(g.length(line), b.width, b.height).alias("divider"), p.vertical_divider(g.slope(line), g.length(line), b.height).alias("upright_divider"), word.alias("word"), fraction.alias("fraction"),
    )


CODE = "CASE WHEN position(c IN 'abcdefghijklmnopqrstuvwxyz0123456789') > 0 THEN position(c IN 'abcdefghijklmnopqrstuvwxyz0123456789') WHEN c = chr(10) THEN 38 WHEN c = '!' THEN 39 WHEN c = '/' THEN 40 ELSE 0 END"
NUMBER = r"regexp_full_match(text, '[0-9]*\.[0-9]+') OR regexp_full_match(text, '[0-9]+/[0-9]+') OR regexp_full_match(text, '[0-9]+')"
SOME = f"NOT ({NUMBER}) AND regexp_matches(text, '^(\"|''|feet|foot|inches|inch?$)', 'i')"
INCHES = f"""({SOME}) AND (text = '"' OR lower(text) IN ('inches', 'inch'))"""
UNIT_FOUND = f"""(CASE WHEN {NUMBER} THEN 2 ELSE 0 END) + (CASE WHEN {SOME} THEN 2 ELSE 0 END) + (CASE WHEN text = '/' THEN 1 ELSE 0 END)"""


@query(
    f"""SELECT id, NOT regexp_full_match(text, '[a-zA-Z]-[0-9][0-9]?') AND lower(text) NOT IN ('sheet no.', 'sheet title') AS page_name, position(chr(10) IN text) > 0 AS multiline,
    list_sum(list_transform(range(0, length(text)), lambda i: (list_transform([substr(text, CAST(i + 1 AS INTEGER), 1)], lambda c: {CODE}))[1] * power(10.0::DOUBLE, i))) AS code,
    '(' || printf('%.2f', id / 4) || ',-1,' || printf('%.2f', id * 1.5::DOUBLE) || ',-1)' AS bounds, {UNIT_FOUND} AS n_labels, CASE WHEN {INCHES} THEN 0.2::DOUBLE ELSE 0 END AS inches,
    round(0.5 * CASE WHEN text = 'feet' THEN 1.0 ELSE 0.0 END + 0.5 * (1 - tanh(abs(CAST(id % 9 AS DOUBLE) - 4))), 6) + 0.0 AS activation,
    CASE text WHEN '"' THEN 'a"' WHEN '/' THEN 'a//' ELSE 'a/' || text END AS joined, CASE WHEN text = '/' THEN 'x//y' WHEN text LIKE '%.5' THEN 'x' || text || '/y' ELSE 'x/' || text || '/y' END AS cells FROM v_labels""",
    "v_labels",
)
def text_scalars(spark: SparkSession, sf: str) -> DataFrame:
    v, text, i = view(spark, sf, "v_labels"), F.col("text"), F.col("id")
    labels = t.label_map(text)
    node = lambda s, bar: F.struct(s.cast("string").alias("text"), F.lit(bar).alias("is_line"), F.lit(1.0).alias("slope"), F.lit(5.0).alias("length"))
    nodes = F.array(node(F.lit("a"), False), node(F.lit(None), True), node(text, False))
    gap = F.struct(F.when(text.like("%.5"), F.lit("")).alias("text"))
    cells = F.array(F.struct(F.lit("x").alias("text")), gap, F.struct(text.alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.lit("y").alias("text")))
    return v.select(
        "id", t.is_page_name(text).alias("page_name"), t.is_multiline(text).alias("multiline"), t.text_code(text).alias("code"), t.bounds_text([i / 4, F.lit(None).cast("double"), i * 1.5, F.lit(None).cast("double")]).alias("bounds"),
        F.size(labels).alias("n_labels"), t.label(labels, "INCHES").alias("inches"), r6(g.text_activation(text, (i % 9).cast("double"), F.lit("feet"), F.lit(4.0))).alias("activation"), t.joined_text(nodes).alias("joined"), t.joined_cells(cells).alias("cells"),
    )
