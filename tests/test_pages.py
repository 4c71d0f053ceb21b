"""Words, fractions, outlines, layers, neighbours and block searches against direct computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import cycles, layers, shapes, spatial, words

BOX = "page int, id long, x0 double, y0 double, x1 double, y1 double"


def glyphs(spark, rows):
    """Upright glyphs of six by ten at (id, x, y, text)."""
    return spark.createDataFrame([(0, i, float(x), float(y), x + 6.0, y + 10.0, t, True, 10.0) for i, x, y, t in rows], BOX + ", text string, left_right boolean, fontsize double")


# boxes that grow


def test_words_join_only_through_a_third(spark):
    # b and c reach nobody alone; a joins with b, and their box then meets c's, which lies above the gap
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, "a", True), (0, 2, 18.0, 0.0, 28.0, 10.0, "b", True), (0, 3, 12.0, 8.0, 16.0, 30.0, "c", True), (0, 4, 12.0, 28.0, 16.0, 40.0, "d", True), (0, 5, 90.0, 0.0, 99.0, 10.0, "e", True), (0, 6, 90.0, 12.0, 99.0, 22.0, "f", False), (0, 7, 90.0, 31.0, 99.0, 41.0, "g", False)]
    nodes = spark.createDataFrame(rows, BOX + ", text string, left_right boolean")
    got = {r.id: (r.text, r.n, r.y1) for r in words.growing(nodes).collect()}
    assert got == {1: ("acdb", 4, 40.0), 5: ("e", 1, 10.0), 6: ("fg", 2, 41.0)}
    assert words.growing(nodes.limit(0)).collect() == []


def grown(rows):
    """Merges any two groups that meet, until none do."""
    groups = [({i}, x0, y0, x1, y1, (x1 - x0) / max(1, len(t))) for _, i, x0, y0, x1, y1, t, _ in rows]
    again = True
    while again:
        again = False
        for a in range(len(groups)):
            for b in range(len(groups)):
                if a != b:
                    (g, ax0, ay0, ax1, ay1, m), (h, bx0, by0, bx1, by1, n) = groups[a], groups[b]
                    if ax0 - m <= bx1 and bx0 <= ax1 + m and ay0 <= by1 and by0 <= ay1:
                        both = (g | h, min(ax0, bx0), min(ay0, by0), max(ax1, bx1), max(ay1, by1), max(m, n))
                        groups = [x for k, x in enumerate(groups) if k not in (a, b)] + [both]
                        again = True
                        break
            if again:
                break
    return sorted((min(g), tuple(sorted(g))) for g, *_ in groups)


@pytest.mark.parametrize("seed", [1])
def test_growing_equals_any_order_of_merges(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(40):
        x, y = rnd.randrange(110), rnd.randrange(80)
        rows.append((0, k, float(x), float(y), x + rnd.randrange(2, 12) * 1.0, y + rnd.randrange(2, 9) * 1.0, "t" * rnd.randint(0, 3), True))
    rnd.shuffle(rows)
    nodes = spark.createDataFrame(rows, BOX + ", text string, left_right boolean")
    made = words.growing(nodes)
    want = grown(rows)
    assert sorted((r.id, r.n) for r in made.collect()) == [(i, len(g)) for i, g in want]


# greedy fractions


def test_two_bars_want_one_number(spark):
    rows = [(1, 0, 20, "3"), (2, 0, 0, "4"), (3, 9, 20, "5"), (4, 30, 0, "7"), (5, 30, 20, "8")]
    nodes = spark.createDataFrame([(0, i, float(x), float(y), x + 8.0, y + 10.0, t, True, 10.0) for i, x, y, t in rows], BOX + ", text string, left_right boolean, fontsize double")
    bars = spark.createDataFrame([(0, 100, 0.0, 15.0, 8.0, 15.0, 8.0), (0, 101, 1.0, 14.0, 9.0, 14.0, 8.0), (0, 102, 30.0, 15.0, 38.0, 15.0, 8.0)], BOX + ", length double")
    got = {(r.node, r.bar, r.other) for r in words.fractions(nodes, bars).collect()}
    assert got == {(1, 100, 2), (4, 102, 5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_one_by_one(spark, monkeypatch, seed):
    """Candidates with long chains of conflicts."""
    rnd = random.Random(seed)
    rows = sorted({(rnd.randrange(3), rnd.randrange(25), round(rnd.random(), 2), 100 + rnd.randrange(12), round(rnd.random(), 2), rnd.randrange(25)) for _ in range(150)})
    rows = [r for r in rows if r[1] != r[5]]
    found = spark.createDataFrame([(p, n, tb, b, to, o, True) for p, n, tb, b, to, o in rows], "page int, node long, to_bar double, bar long, to_other double, other long, node_first boolean")
    monkeypatch.setattr(words, "fraction_candidates", lambda *_: found)
    got = sorted((r.page, r.node, r.bar, r.other) for r in words.fractions(found, found).collect())
    used, want = set(), []
    for p, n, _, b, _, o in rows:
        mine = {(p, "n", n), (p, "b", b), (p, "n", o)}
        if not mine & used:
            used |= mine
            want.append((p, n, b, o))
    assert got == sorted(want)


# cycles


def ring(n, x=0.0, y=0.0, r=30.0, first=0):
    at = [(x + round(r * math.cos(2 * math.pi * k / n), 6), y + round(r * math.sin(2 * math.pi * k / n), 6)) for k in range(n)]
    return {first + k: (*at[k], *at[(k + 1) % n]) for k in range(n)}


def test_each_line_outside_the_trees_closes_one_cycle():
    grid = {}
    for i in range(5):
        for j in range(5):
            if i < 4:
                grid[len(grid)] = (float(i), float(j), i + 1.0, float(j))
            if j < 4:
                grid[len(grid)] = (float(i), j + 1.0, float(i), float(j))
    grid[len(grid)] = (9.0, 9.0, 9.0, 9.0)  # no length
    found = cycles.fundamental_cycles(grid)
    assert len(found) == 40 - 25 + 1
    for cycle in found:
        assert len(set(cycle)) == len(cycle) >= 4
        at = grid[cycle[0]][2:]
        for k in cycle[1:]:  # every line begins where the one before ended
            assert at in (grid[k][:2], grid[k][2:])
            at = grid[k][2:] if grid[k][:2] == at else grid[k][:2]
        assert at == grid[cycle[0]][:2]
    long = {k: (float(k), 0.0, k + 1.0, 0.0) for k in range(30000)} | {30000: (30000.0, 0.0, 0.0, 0.0)}
    assert len(cycles.fundamental_cycles(long)[0]) == 30001


def test_outlines_of_tangled_drawings(spark):
    lines = ring(24) | ring(6, x=100.0, first=30) | {40: (30.0, 0.0, 50.0, 5.0), 41: (50.0, 5.0, 60.0, -5.0), 42: (60.0, -5.0, 30.0, 0.0)} | ring(6, x=200.0, first=50)
    lines[60] = (*lines[50][:2], *lines[53][:2])  # a chord: no hexagon is left
    rows = [(p, k + 1000 * p, *v) for p in range(3) for k, v in lines.items()]
    got = sorted((r.page, r.kind, r.n, min(r.ids) % 1000) for r in cycles.outlines(spark.createDataFrame(rows, BOX)).collect())
    assert got == sorted((p, kind, n, first) for p in range(3) for kind, n, first in (("circle", 24, 0), ("hexagon", 6, 30)))


def test_lines_cut_where_they_cross_form_a_hexagon(spark):
    """Six long lines whose ends lie outside: only the pieces between crossings close."""
    at = [(30 * math.cos(math.pi * k / 3), 30 * math.sin(math.pi * k / 3)) for k in range(6)]
    rows = []
    for k in range(6):
        (x0, y0), (x1, y1) = at[k], at[(k + 1) % 6]
        dx, dy = (x1 - x0) * 0.3, (y1 - y0) * 0.3
        rows.append((0, k, x0 - dx, y0 - dy, x1 + dx, y1 + dy))
    segments = spark.createDataFrame(rows, BOX)
    assert cycles.outlines(segments).count() == 0
    cut = cycles.cut_at_crossings(segments)
    assert cut.groupBy("id").count().filter("count = 3").count() == 6
    pieces = cut.withColumn("id", F.col("id") * 10 + F.col("piece"))
    assert [(r.kind, r.ids) for r in cycles.outlines(pieces).collect()] == [("hexagon", [2, 12, 22, 32, 42, 52])]


# layers


def test_layers_of_a_page(spark):
    lines = spark.createDataFrame([(0, k, *v) for k, v in ring(24, 200.0, 205.0).items()], BOX)
    rows = [(1, 194, 200, "D"), (2, 200, 200, "1"), (3, 0, 20, "3"), (4, 0, 0, "4"), (5, 6, 10, "i"), (6, 12, 10, "n")]
    bars = spark.createDataFrame([(0, 90, 0.0, 15.0, 6.0, 15.0, 6.0)], BOX + ", length double")
    made = layers.activate(lines, glyphs(spark, rows), bars, shapes.template_lines(lines.withColumn("shape", F.lit(7)), "shape"), "shape")
    nodes = {r.node: (r.layer, r.name, sorted(r.children)) for r in made.collect()}
    assert nodes["circle:0"][0] == 1 and len(nodes["circle:0"][2]) == 24
    assert nodes["label:circle:0"] == (2, "D1", ["circle:0", "word:1"])
    assert nodes["fraction:3"] == (2, "3/4", ["line:90", "word:3", "word:4"])
    assert nodes["phrase:3"] == (3, "3/4in", ["fraction:3", "word:5"])
    assert [k for k in nodes if k.startswith("shape:")] == ["shape:7:170:175"] or any(k.startswith("shape:7") for k in nodes)
    links = {(r.parent, r.child) for r in layers.edges(made).collect()}
    assert ("label:circle:0", "word:1") in links and ("word:1", "glyph:2") in links
    assert {r.node for r in layers.orphans(made, 1).collect()} == {k for k in nodes if k.startswith("shape:")}
    empty = layers.activate(lines.limit(0), glyphs(spark, rows).limit(0), bars.limit(0), shapes.template_lines(lines.limit(0).withColumn("shape", F.lit(7)), "shape"), "shape")
    assert empty.collect() == []


# neighbours


def boxes(spark, seed, n, wide):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = rnd.randrange(wide), rnd.randrange(wide)
        rows.append((k % 2, k, float(x), float(y), float(x + rnd.randrange(40)), float(y + rnd.randrange(40))))
    return rows, spark.createDataFrame(rows, BOX)


@pytest.mark.parametrize(("seed", "n", "wide"), [(1, 120, 200), (2, 30, 3000), (3, 5, 10)])
def test_neighbours_and_nearest_equal_all_pairs(spark, seed, n, wide):
    rows, df = boxes(spark, seed, n, wide)

    def side(a, gap, across):
        near = [(gap(a, b), b[1]) for b in rows if b[0] == a[0] and b[1] != a[1] and across(a, b) and gap(a, b) >= 0]
        return min(near)[1] if near else None

    level = lambda a, b: a[3] <= b[5] and b[3] <= a[5]
    above = lambda a, b: a[2] <= b[4] and b[2] <= a[4]
    want = {a[1]: (side(a, lambda a, b: a[2] - b[4], level), side(a, lambda a, b: b[2] - a[4], level), side(a, lambda a, b: a[3] - b[5], above), side(a, lambda a, b: b[3] - a[5], above)) for a in rows}
    assert {r.id: (r.left_id, r.right_id, r.below_id, r.above_id) for r in spatial.neighbours(df).collect()} == want

    def apart(a, b):
        return math.hypot(max(0, a[2] - b[4], b[2] - a[4]), max(0, a[3] - b[5], b[3] - a[5]))

    want = {(a[1], k + 1): i for a in rows for k, (_, i) in enumerate(sorted((apart(a, b), b[1]) for b in rows if b[0] == a[0] and b[1] != a[1])[:4])}
    assert {(r.source_id, r.nth): r.id for r in spatial.nearest(df, df, 4).collect()} == want
    assert spatial.nearest(df.limit(0), df, 2).collect() == [] and spatial.neighbours(df.limit(0)).collect() == []


# blocks


def test_nearest_curves_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(shapes, "BLOCK", 7)
    rnd = random.Random(5)
    rows = []
    for shape in range(90):
        for k in range(rnd.randint(1, 5)):
            x, y = rnd.randrange(100), rnd.randrange(100)
            rows.append((shape % 2, shape, k, float(x), float(y), float(x + rnd.randrange(-20, 20)), float(y + rnd.randrange(-20, 20))))
    df = spark.createDataFrame(rows, "page int, shape long, id long, x0 double, y0 double, x1 double, y1 double")
    c = shapes.curves(df, ["shape", "page"]).cache()
    pairs = shapes.most_similar(c, c, "shape", "shape", 300.0, ["page"], F.col("q_shape") != F.col("c_shape"))
    blocks = shapes.nearest_curves(c, c, "shape", "shape", 300.0, ["page"])
    assert sorted((r.shape, r.match_id, round(r.distance, 9)) for r in blocks.collect()) == sorted((r.shape, r.match_id, round(r.distance, 9)) for r in pairs.collect())


def test_bounds_never_exceed_distances():
    rnd = np.random.default_rng(1)
    lines = [rnd.integers(0, 60, (rnd.integers(1, 6), 4)).astype(float) for _ in range(40)]
    lists = pa.array([[dict(zip(("x0", "y0", "x1", "y1"), r, strict=True)) for r in curve.tolist()] for curve in lines])
    a = shapes._coordinates(lists)
    anchors = a[0][:2]
    low, high = shapes._spread(*a, anchors)
    bound = shapes._bounds(a[0], a[1], a[2], low, high, a[2], anchors)
    i, j = (x.ravel() for x in np.indices(bound.shape))
    exact = shapes._exact(a, a, i, j).reshape(bound.shape)
    assert (bound <= exact + 1e-9).all() and (bound > 0).any()
    assert np.allclose(exact.ravel(), shapes.set_distances(lists.take(pa.array(i)), lists.take(pa.array(j))))


@pytest.mark.parametrize("least", [0.4, 0.9])
def test_votes_in_small_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(shapes, "BLOCK_LINES", 10)
    rnd = random.Random(7)
    rows = []
    for k in range(240):
        x, y = rnd.randrange(60), rnd.randrange(60)
        rows.append((k % 3, k, float(x), float(y), float(x + rnd.choice([-3, 0, 5, 8])), float(y + rnd.choice([-4, 0, 6]))))
    lines = spark.createDataFrame(rows, BOX)
    templates = shapes.template_lines(lines.withColumn("shape", F.floor(F.col("id") / 4)), "shape")
    plain = shapes.found_shapes(shapes.votes(lines, templates, "shape"), "shape", least=least)
    blocks = shapes.scored(lines, templates, "shape", least=least)
    key = lambda r: (r.page, r.cell_x, r.cell_y, r["shape"], round(r.score, 9))
    assert sorted(map(key, blocks.collect())) == sorted(map(key, plain.collect()))
    # a page whose lines are unlike a shape's is dropped before any vote
    other = spark.createDataFrame([(9, 1, 0.0, 0.0, 500.0, 1.0)], BOX)
    assert shapes.scored(other, templates, "shape", least=least).collect() == []
