"""Crowded pages: copies of boxes are compared once, and no join collects exploded rows on the driver."""

from __future__ import annotations

import math
import random
import re

import pytest

import __spark_entry__ as entry

from inkgrid.operators import graph, spatial
from inkgrid.plans.queries import QUERIES


def crowd(n: int = 160) -> list[tuple]:
    """(page, id, box): few places, so most boxes have copies; some without width or height."""
    rng = random.Random(5)
    rows = []
    for k in range(n):
        x, y = rng.randrange(6) * 10.0, rng.randrange(5) * 10.0
        rows.append((k % 2, k, x, y, x + rng.choice((0, 5, 20)), y + rng.choice((0, 5, 20))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "page bigint, id bigint, x0 double, y0 double, x1 double, y1 double")


def meets(a, b) -> bool:
    return a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]


def test_meeting_copies_F11(spark):
    rows = crowd()
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and meets(a, b))
    got = spatial.id_pairs(spatial.meeting(frame(spark, rows)).select("a_id", "b_id", "a_ids", "b_ids")).collect()
    assert sorted((r.a_id, r.b_id) for r in got) == want


@pytest.mark.parametrize("name", ["box_intersection", "bbox_overlap_area_page", "label_surroundings", "region_votes", "top_left_in"])
def test_nothing_is_broadcast_F12(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_components_of_copies_F13(spark):
    rows = [r for r in crowd(60) if (r[2] + r[3]) % 20 == 0] + [(0, 900, 500.0, 0.0, 510.0, 10.0), (0, 901, 500.0, 0.0, 510.0, 10.0), (1, 902, 800.0, 0.0, 810.0, 10.0)]
    root = {r[1]: r[1] for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if meets(a, b):
                    root[a[1]] = root[b[1]] = min(root[a[1]], root[b[1]])
    linked = {a[1] for a in rows for b in rows if a[1] != b[1] and meets(a, b)}
    got = {r.node: r.component for r in spatial.meeting_components(frame(spark, rows)).collect()}
    assert got == {k: v for k, v in root.items() if k in linked} and 902 not in got and got[901] == 900


def test_stored_tables_are_not_broadcast_F18(spark):
    a = graph.stored(spark.range(10).toDF("id"), "a")
    assert "SortMergeJoin" in a.filter("id > 1").join(spark.range(5).toDF("id"), "id")._jdf.queryExecution().executedPlan().toString()


def test_nearest_takes_first_ids_F19(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FIRST", (8, 20))
    rows = crowd()
    gap = lambda a, b: (max(0, a[2] - b[4], b[2] - a[4]) ** 2 + max(0, a[3] - b[5], b[3] - a[5]) ** 2) ** 0.5
    want = {a[1]: [b[1] for b in sorted((b for b in rows if b[0] == a[0] and b[1] != a[1]), key=lambda b: (gap(a, b), b[1]))[:3]] for a in rows}
    got: dict = {}
    for r in spatial.nearest(frame(spark, rows), frame(spark, rows), 3).orderBy("nth").collect():
        got.setdefault(r.source_id, []).append(r.id)
    assert got == want


def test_votes_of_copies_F20(spark):
    from pyspark.sql import functions as F

    rows = crowd()
    boxes = frame(spark, rows).withColumn("kind", F.col("id") % 3)
    area = lambda a, b: (lambda w, h: w * h if w and h else 0.1 * h if not w else w * 0.1)(min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3]))
    want: dict = {}
    for a in rows:
        for b in rows:
            if meets(a, b):
                want[a[1], b[1] % 3] = want.get((a[1], b[1] % 3), 0) + area(a, b)
    got = {(r.id, r.kind): r.votes for r in spatial.region_votes(boxes, boxes, "kind").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_areas_of_a_group_are_not_broadcast_F14(spark, sf_dir):
    plan = QUERIES["bbox_overlap_area"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "b_x0" in plan and "_k#" in plan and "SortMergeJoin [page" in plan


def test_parts_of_fractions_are_not_broadcast_F15(spark):
    from inkgrid.operators import words
    from inkgrid.plans.queries import fraction_pages

    nodes, bars = fraction_pages(spark.range(20).selectExpr("id AS p_partkey", "id AS p_size"))
    matched = spark.createDataFrame([(0, 0, 2, 1, True)], "page bigint, node bigint, bar bigint, other bigint, node_first boolean")
    plan = words.fraction_nodes(nodes, bars, matched)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_box_pairs_in_blocks_F1(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 7)
    rows = crowd()
    got = spatial.expanded(spatial.box_pairs(frame(spark, rows)).select("page", "a_ids", "b_ids", "a_id", "b_id")).filter("a_id < b_id").collect()
    assert sorted((r.a_id, r.b_id) for r in got) == [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]


def test_neighbours_of_copies_F8(spark):
    rows = crowd()
    sides = {"left_id": (0, 2, 4, 1), "right_id": (0, 4, 2, -1), "below_id": (1, 3, 5, 1), "above_id": (1, 5, 3, -1)}
    got = {r.id: r for r in spatial.neighbours(frame(spark, rows)).collect()}
    for a in rows:
        for name, (up, own, other, sign) in sides.items():
            low, high = (2, 4) if up else (3, 5)
            found = [((a[own] - b[other]) * sign, b[1]) for b in rows if b[0] == a[0] and b[1] != a[1] and a[low] <= b[high] and b[low] <= a[high] and (a[own] - b[other]) * sign >= 0]
            assert got[a[1]][name] == (min(found)[1] if found else None)


def test_corners_of_copies_F25(spark):
    rows = crowd()
    got = spatial.top_left_ids(frame(spark, rows)).collect()
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] <= b[2] <= a[4] and a[3] <= b[5] <= a[5])
    assert sorted((r.o_id, r.i_id) for r in got) == want


def test_common_pattern_is_many_tasks_F21(spark, monkeypatch):
    import re

    from pyspark.sql import functions as F

    from inkgrid.operators import rules

    monkeypatch.setattr(rules, "CHUNK", 8, raising=False)
    labels = [(k // 4 % 2, k, ("A1", "A12 ", "D5", "B")[k % 4]) for k in range(200)]
    own = [(k // 4 % 2, k, ("A##", "D5", "A1|B", "")[k % 4]) for k in range(100, 180)]
    got = rules.label_matches(spark.createDataFrame(labels, "page long, id long, text string"), spark.createDataFrame(own, "page long, rule_id long, row_id string"), wildcard=True)
    found = got.withColumn("task", F.spark_partition_id()).collect()
    pattern = lambda r: "(" + r.replace("##", "[0-9][0-9]?") + ")[\n ]?"
    want = sorted((i, r) for p, i, x in labels for q, r, row in own if p == q and row and re.fullmatch(pattern(row), x))
    assert sorted((r.id, r.rule_id) for r in found) == want and {r.label for r in found} == {"A1", "A12", "D5", "B"}
    assert len({r.task for r in found if r.page == 0 and r.rule_id % 4 == 0}) > 1


def test_runs_of_texts_F23(spark, sf_dir, monkeypatch):
    from inkgrid.operators import words
    from inkgrid.plans.views import glyphs

    monkeypatch.setattr(words, "PIECE", 5)
    texts = ["", " ", "  a  b ", "ab" * 30, "é😀 ß", None, "a\nb c", "", "d"]
    lines = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    row = lambda r: (r.doc_id, r.x0, r.y0, r.x1, r.y1, r.n, r.text)
    want = sorted(map(row, words.runs(glyphs(lines), ["doc_id"], "pos").collect()))
    assert sorted(map(row, words.runs_of_texts(lines, ["doc_id"]).collect())) == want
    plan = QUERIES["words_from_glyphs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def lines_of(spark, n: int = 90):
    rng = random.Random(7)
    rows = [(k % 2, k, *(float(rng.choice((0, 7, 20, 300))) for _ in range(4))) for k in range(n)]
    return rows, frame(spark, rows)


def crossing(a, b):
    """Where two lines of one page meet, or None."""
    k = (a[2] - a[4]) * (b[3] - b[5]) - (b[2] - b[4]) * (a[3] - a[5])
    if a[0] != b[0] or not k:
        return None
    da, db = a[2] * a[5] - a[3] * a[4], b[2] * b[5] - b[3] * b[4]
    x, y = (da * (b[2] - b[4]) - (a[2] - a[4]) * db) / k, (da * (b[3] - b[5]) - (a[3] - a[5]) * db) / k
    near = all(min(s[2], s[4]) - 0.1 <= x <= max(s[2], s[4]) + 0.1 and min(s[3], s[5]) - 0.1 <= y <= max(s[3], s[5]) + 0.1 for s in (a, b))
    return (x + 0.0, y + 0.0) if near else None


def test_crossings_of_copies_F24(spark):
    rows, lines = lines_of(spark)
    want = {(a[1], b[1]): crossing(a, b) for a in rows for b in rows if a[1] < b[1] and crossing(a, b)}
    got = spatial.crossings(lines).collect()
    assert len(got) == len(want) and {(r.a_id, r.b_id): (r.px, r.py) for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    # different lines meet once, whatever copies there are, and no level is filled that no line is at home on
    once = spatial.line_crossings(lines).collect()
    assert len(once) < len(got) and all(r.a_id == min(r.a_ids) and r.b_id == min(r.b_ids) for r in once)
    assert spatial.levels_of(spatial.boxed(lines), cell=16.0, levels=5, span=2) == [0, 4]


def test_first_crossings_of_copies_F5(spark):
    rows, lines = lines_of(spark)
    want: dict = {}
    for a in rows:
        for b in rows:
            if a[1] != b[1] and (at := crossing(a, b)):
                key = (a[1], round(at[0], 6), round(at[1], 6))
                want[key] = min(b[1], want.get(key, b[1]))
    from pyspark.sql import functions as F

    got = spatial.first_crossings(lines, at=lambda c: F.round(c, 6)).collect()
    assert len(got) == len(want) and {(r.id, round(r.px, 6), round(r.py, 6)): r.partner for r in got} == want


def test_cut_copies_F3(spark):
    from inkgrid.operators import cycles

    rows, lines = lines_of(spark, 60)
    got: dict = {}
    for r in cycles.cut_at_crossings(lines).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append((r.x0, r.y0, r.x1, r.y1))
    for a in rows:
        same = min(b[1] for b in rows if b[0] == a[0] and b[2:] == a[2:])
        points = {a[2:4], a[4:6]} | {(round(c[0], 6), round(c[1], 6)) for b in rows if (c := crossing(a, b))}
        assert len(got.get(a[1], [])) == len(points) - 1 and got.get(a[1]) == got.get(same)


@pytest.mark.parametrize("within", [[], ["page"]])
def test_scores_of_copies_F10_F22(spark, monkeypatch, within):
    from pyspark.sql import functions as F

    from inkgrid.operators import shapes

    monkeypatch.setattr(shapes, "BLOCK_LINES", 8)
    v = lines_of(spark, 120)[1].withColumn("shape", (F.col("page") * 1000 + F.floor(F.col("id") / 8)).cast("long"))
    templates = shapes.template_lines(v, "shape").withColumn("page", F.floor(F.col("shape") / 1000).cast("long"))
    templates = templates if within else templates.drop("page")
    row = lambda r: (r.page, r.cell_x, r.cell_y, r.shape, round(r.score, 9))
    want = sorted(map(row, shapes.found_shapes(shapes.votes(v, templates, "shape", within=within), "shape", least=0.4).collect()))
    found = shapes.scored(v, templates, "shape", least=0.4, within=within)
    assert sorted(map(row, found.collect())) == want and want
    # the segments of a block are different ones
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "line_id" not in plan.split("FlatMapCoGroups")[1].splitlines()[0] and "Aggregate [page#" in plan


def broadcast_joins(spark, run) -> list[str]:
    """Keys of the hash joins with a broadcast side in all that `run` executes, its stored tables included; constants of the code are left out."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = store.executionsList()
    shown = [plans.apply(i).physicalPlanDescription() for i in range(first, plans.size())]
    assert any("SortMergeJoin" in text for text in shown)
    keys = [k for text in shown for k in re.findall(r"\) BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\n]*)\]", text)]
    return [k for k in keys if not k.startswith(("key_text", "schedule"))]


@pytest.mark.parametrize("name", ["connected_components_F13", "fractions_F15", "growing_words_F16", "document_json_F17"])
def test_no_round_broadcasts(spark, sf_dir, name):
    assert broadcast_joins(spark, lambda: entry.queries()[name.rpartition("_")[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()) == []


def test_components_descend_in_few_rounds_F13(spark):
    # a row of boxes, each of which meets the next: the way down is as long as the row
    rows = [(0, k, k * 10.0, 0.0, k * 10.0 + 10.0, 5.0) for k in range(40)] + [(1, 100 - k, k * 10.0, 0.0, k * 10.0 + 10.0, 5.0) for k in range(8)]
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    got = {r.node: r.component for r in spatial.meeting_components(frame(spark, rows)).collect()}
    assert got == {k: 0 for k in range(40)} | {100 - k: 93 for k in range(8)}
    at = graph.descended(spark.createDataFrame([(k, max(0, k - 1) if k else 1) for k in range(40)], "a bigint, b bigint"))
    assert {r.node: r.component for r in at.collect()} == {k: 0 for k in range(40)}
    assert store.executionsCount() - first < 40


def test_shape_parents_vote_in_blocks_F6(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from inkgrid.operators import layers, shapes
    from inkgrid.plans.views import view

    lines = view(spark, sf_dir, "v_rings").cache()
    again = lines.withColumn("id", F.col("id") + 100000)  # copies vote alike: the smaller id counts
    templates = shapes.template_lines(lines, "ring")
    best = shapes.best_votes(shapes.votes(lines.unionByName(again), templates, "ring"), "ring")
    low = {r.id: (min(r.x0, r.x1), min(r.y0, r.y1), max(r.x0, r.x1), max(r.y0, r.y1)) for r in lines.unionByName(again).collect()}
    made: dict = {}
    for r in best.collect():
        made.setdefault((r.page, f"shape:{r.ring}:{r.cell_x}:{r.cell_y}", r.n_lines), []).append((r.activation, r.node_id))
    want = {}
    for (page, node, n), got in made.items():
        if sum(a for a, _ in got) / n > 0.4:
            ids = sorted({i for _, i in got})
            sides = list(zip(*[low[i] for i in ids], strict=True))
            want[page, node] = ([f"line:{i}" for i in ids], min(sides[0]), min(sides[1]), max(sides[2]), max(sides[3]))
    monkeypatch.setattr(shapes, "TOGETHER", 16)
    parents = layers.shape_parents(lines.unionByName(again), templates, "ring", least=0.4)
    assert "activation" not in parents._jdf.queryExecution().executedPlan().toString()
    assert {(r.page, r.node): (r.children, r.x0, r.y0, r.x1, r.y1) for r in parents.collect()} == want and want


def curve_table(lines, ratio, key):
    import numpy as np
    import pyarrow as pa

    flat = np.concatenate(lines)
    ends = np.r_[0, np.cumsum([len(c) for c in lines])].astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(4)], ["x0", "y0", "x1", "y1"])
    return pa.table({"lines": pa.ListArray.from_arrays(pa.array(ends), structs), "ratio": pa.array(ratio), "key": pa.array(key)})


def nearest_by_all_pairs(table, most):
    import numpy as np

    from inkgrid.operators import shapes

    a, key, ratio = shapes._coordinates(table["lines"].combine_chunks()), table["key"].to_numpy(), table["ratio"].to_numpy()
    found = {}
    for q in range(len(key)):
        d = shapes._exact(a, a, np.full(len(key), q), np.arange(len(key)))
        d[(key == key[q]) | (np.abs(ratio - ratio[q]) > shapes.RATIO)] = np.inf
        c = np.lexsort((key, d))[0]
        if d[c] < most:
            found[key[q]] = (key[c], d[c])
    return found


@pytest.mark.parametrize("wide, many", [(40, 5), (7, 4), (90, 9), (3, 3)])
def test_curves_by_tree_F7(monkeypatch, wide, many):
    import numpy as np

    from inkgrid.operators import shapes

    rnd = np.random.default_rng(wide)
    lines = [(rnd.integers(0, wide, (rnd.integers(1, many), 4)) + rnd.integers(0, 2) / 3.0).astype(float) for _ in range(500)]
    table = curve_table(lines, rnd.choice([0.5, 0.55, 0.6, 0.7, 1.0, 1.05, 1000.0], 500), rnd.permutation(500) * 7)
    key = table["key"].to_numpy()
    monkeypatch.setattr(shapes, "LEAF", 8, raising=False)
    for most in (3.0, 300.0):
        want = nearest_by_all_pairs(table, most)
        i, j, d = shapes.nearest_of_block(table, table, most)
        assert {key[x]: (key[y], z) for x, y, z in zip(i, j, d, strict=True)} == want and len(i) == len(want)


def looked_at(monkeypatch, table, **more) -> tuple[tuple, list[int]]:
    """What a search of a block finds, and for how many pairs bounds and distances are taken at a time."""
    import numpy as np

    from inkgrid.operators import shapes

    seen = []

    def counted(name):
        plain = getattr(shapes, name, None)

        def call(*args):
            got = plain(*args)
            seen.append(np.size(got[0] if isinstance(got, tuple) else got))
            return got

        monkeypatch.setattr(shapes, name, call, raising=False)

    for name in ("_bounds", "_exact", "_apart", "_matched"):
        counted(name)
    return shapes.nearest_of_block(table, table, 400.0, **more), seen


def test_curves_are_not_all_compared_F7(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    n = 3000
    start = np.array([(0, 0), (36, 48), (72, 96), (108, 144)], float)
    far = rnd.integers(-20, 21, (n, 4, 2)) + rnd.integers(0, 12, (n, 1, 1)) * 40
    lines = [np.column_stack([start, start + f]) for f in far]
    key = np.arange(n)
    (i, j, d), seen = looked_at(monkeypatch, curve_table(lines, np.full(n, 1.3), key))
    assert len(i) == n and sum(seen) < n * n / 4
    # copies stand once: all but the first match the first one
    lines = [lines[0]] * n
    monkeypatch.undo()
    (i, j, d), seen = looked_at(monkeypatch, curve_table(lines, np.full(n, 1.3), key))
    assert (d == 0).all() and dict(zip(i.tolist(), j.tolist(), strict=True)) == {k: 0 if k else 1 for k in range(n)} and sum(seen) < n * 200


def test_any_close_curve_settles_a_shape_F9(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(4)
    n = 2000
    start = np.array([(0, 0), (36, 48), (72, 96), (108, 144)], float)
    lines = [np.column_stack([start, start + f]) for f in rnd.integers(-20, 21, (n, 4, 2)) + rnd.integers(0, 12, (n, 1, 1)) * 40]
    lines += [np.column_stack([start * 9, start + 3000 + 60 * k]) for k in range(5)]
    table = curve_table(lines, np.full(n + 5, 1.3), np.arange(n + 5))
    (i, j, d), nearest = looked_at(monkeypatch, table)
    monkeypatch.undo()
    (a, b, e), some = looked_at(monkeypatch, table, enough=59.9)
    assert (d >= 60).any() and a.tolist() == i.tolist() and (a != b).all()
    assert ((e == d) | (e < 59.9)).all() and sum(some) < sum(nearest) / 2


def test_group_division_asks_for_no_nearest_curve_F9(spark, sf_dir, monkeypatch):
    from inkgrid.operators import shapes

    asked = []
    plain = shapes.nearest_curves
    monkeypatch.setattr(shapes, "nearest_curves", lambda *a: asked.append(a) or plain(*a))
    QUERIES["shape_group_division"](spark, sf_dir)
    assert len(asked) == 1 and 59.99 < asked[0][6] < 60 - 5e-7 and 60 <= asked[0][4] < 61


def test_areas_are_compiled_methods_F14(spark, sf_dir):
    # a method of more than 8,000 bytes is interpreted, row by row; lists of boxes meet instead of boxes
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = QUERIES["bbox_overlap_area"](spark, sf_dir)
        text = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_box_pairs_in_lists_F14(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LIST", 3, raising=False)
    rows = crowd()
    found = spatial.box_pairs(frame(spark, rows))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(_") == 2
    got = spatial.expanded(found.select("page", "a_ids", "b_ids", "a_id", "b_id")).filter("a_id < b_id").collect()
    assert sorted((r.a_id, r.b_id) for r in got) == [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]


def test_geometry_is_compiled_methods_F3(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = QUERIES["bbox_geometry_page"](spark, sf_dir)
        text = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_six_digits_equal_round_F3(spark):
    from pyspark.sql import functions as F

    from inkgrid.plans.queries import r6

    rng = random.Random(3)
    values = [0.0, -0.0, 1e-7, 4e-7, 5e-7, 0.0000005, 0.0000015, -0.0000005, 2.5, 1e5, 99999.9999995, 123456.7890125, 1e14 + 0.1, 1e300, float("nan"), float("inf"), float("-inf"), None]
    values += [s * rng.randrange(10**12) / 10**k for s in (1, -1) for k in (5, 6, 7, 8, 9) for _ in range(300)]
    values += [math.sqrt(rng.randrange(1, 10**7)) for _ in range(3000)] + [(2 * rng.randrange(10**9) + 1) / 2 / 10**6 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(r6(F.col("v")).alias("a"), (F.round("v", 6) + F.lit(0.0)).alias("b")).collect()
    assert len(rows) == len(values) and all(r.a is r.b or repr(r.a) == repr(r.b) for r in rows)


def test_few_boxes_with_many_pairs_are_many_tasks_F1(spark):
    from pyspark.sql import functions as F

    n = 2 * spatial.LIST
    boxes = frame(spark, [(0, k, float(k), 0.0, k + 5.0, 9.0) for k in range(4 * n)])
    tasks = spatial.box_pairs(boxes).groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 4 * n * (4 * n - 1) // 2


def test_lines_of_all_sizes_cross_in_lists_F4(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LIST", 3)
    rng = random.Random(4)
    near = lambda at, size: at + rng.choice((-1, 1)) * (rng.randrange(size) + 0.5 * rng.randrange(2))
    # at most a unit, a cell, many cells and a plane long, about the corner of four cells
    starts = [(near(0.0, 40), near(0.0, 40)) for _ in range(160)]
    rows = [(k % 2, k, x, y, near(x, (2, 30, 200, 5000)[k // 2 % 4]), near(y, (2, 30, 200, 5000)[k // 2 % 4])) for k, (x, y) in enumerate(starts)]
    rows += [(0, 160, 31.9, 40.0, 31.9, 60.0), (0, 161, 32.05, 50.0, 45.0, 50.0), (0, 162, 1e9, 0.0, -1e9, 1.0)]
    want = {(a[1], b[1]): crossing(a, b) for a in rows for b in rows if a[1] < b[1] and crossing(a, b)}
    got = spatial.crossings(frame(spark, rows)).collect()
    assert len(got) == len(want) > 500 and {(r.a_id, r.b_id): (r.px, r.py) for r in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_lines_travel_in_lists_F4(spark):
    # a line was a row in each of up to nine cells a level; now lists travel, and no box beside its line
    rows, lines = lines_of(spark)
    plan = spatial.line_crossings(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "_lines" in plan and "sequence" not in plan


def test_ids_are_expanded_apart_F5(spark, sf_dir):
    # compiled code keeps all that one row of its input makes: ids of both sides in one stage are millions of rows
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("top_left_in", "bbox_geometry"):
            plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            at = {column: stage for stage, column in re.findall(r"\*\((\d+)\) Generate explode\((\w+)#", plan)}
            ids = [at[c] for c in at if c.endswith("_ids")]
            assert len(ids) == len(set(ids)) == 2 and not set(ids) & {at.get("_b")}, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_places_are_numbered_without_ranks_F2(monkeypatch):
    import numpy as np

    from inkgrid.operators import shapes

    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 5, 500), rng.integers(-40, 40, 500), rng.integers(-3, 9, 500)]
    far = [parts[0], parts[1] * (1 << 50), parts[2] * (1 << 40)]
    for rows in (parts, far, parts[:2], [v[:0] for v in parts]):
        want = np.unique(np.stack(rows, 1), axis=0, return_inverse=True)[1].ravel()
        assert np.unique(shapes._places(*rows), return_inverse=True)[1].tolist() == want.tolist()
    sorts = []
    monkeypatch.setattr(shapes.np, "unique", lambda *a, **k: sorts.append(a))
    shapes._places(*parts)
    assert not sorts
