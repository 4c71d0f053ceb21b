from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry as g
from inkgrid.operators import boxes, cycles, graph, rules, shapes, spatial, summary, tables, words
from inkgrid.plans.queries import outline_pages
from inkgrid.sources import elements
from inkgrid.streaming import progress

BOX = "page int, id long, x0 double, y0 double, x1 double, y1 double"


def some_boxes(seed: int, n: int, size: float) -> list[tuple]:
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rnd.uniform(-500, 500), rnd.uniform(-500, 500)
        out.append((rnd.randrange(2), k, x, y, x + rnd.choice([0, 1, rnd.uniform(0, size)]), y + rnd.uniform(0, size)))
    return out


@pytest.mark.parametrize("seed, size", [(1, 20.0), (2, 300.0), (3, 5000.0)])
def test_grid_joins_equal_nested_loops(spark, seed, size):
    rows = some_boxes(seed, 120, size)
    df = spark.createDataFrame(rows, BOX)
    got = {(r["o_id"], r["i_id"]) for r in spatial.containment(df, df).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[2] and a[3] <= b[3] and a[4] >= b[4] and a[5] >= b[5]}
    assert got == want
    pairs = [(r["a_id"], r["b_id"]) for r in spatial.intersection(df, df).collect()]
    meet = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == meet


def test_empty_boxes(spark):
    df = spark.createDataFrame([], BOX)
    assert spatial.containment(df, df).count() == 0 and spatial.neighbours(df).count() == 0
    assert boxes.bounding_box(df, ["page"]).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_duplicate_boxes(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.0, 0.0, 9.8, 9.8), (0, 2, 8.0, 0.0, 12.0, 5.0), (0, 3, 50.0, 50.0, 52.0, 52.0), (0, 4, 50.0, 50.0, 52.0, 51.9)], BOX)
    assert sorted(r.id for r in boxes.drop_covered(df, ["page"]).collect()) == [0, 2, 3, 4]
    assert sorted(r.id for r in boxes.suppress(df, ["page"]).collect()) == [0, 2, 3]
    assert sorted(r.id for r in boxes.suppress(df, ["page"], touching=True).collect()) == [0, 3]
    assert boxes.largest_box(df, ["page"]).first()["id"] == 0


def test_outlines(spark):
    found = cycles.outlines(outline_pages(spark.createDataFrame([(1,)], "s_suppkey long"))).collect()
    assert sorted((r.kind, r.n) for r in found) == [("circle", 24), ("hexagon", 6)]
    lines = outline_pages(spark.createDataFrame([(1,)], "s_suppkey long"))
    assert cycles.unused_lines(lines, cycles.outlines(lines)).count() == 12


def test_phrase_of_fraction(spark):
    nodes = [(0, 1, 0.0, 5.0, 6.0, 15.0, "1", True, 10.0), (0, 2, 10.0, 13.0, 16.0, 23.0, "3", True, 10.0), (0, 3, 10.0, -3.0, 16.0, 7.0, "4", True, 10.0)]
    glyphs = spark.createDataFrame(nodes, "page int, id long, x0 double, y0 double, x1 double, y1 double, text string, left_right boolean, fontsize double")
    bars = spark.createDataFrame([(0, 9, 10.0, 10.0, 16.0, 10.0, 6.0)], "page int, id long, x0 double, y0 double, x1 double, y1 double, length double")
    assert "13/4" in [r.text for r in words.phrases(glyphs, bars).collect()]


def test_words_by_links(spark):
    rows = [(0, k, 6.0 * k, 0.0, 6.0 * k + 6, 10.0, c, True, 10.0) for k, c in enumerate("ab cd")]
    glyphs = spark.createDataFrame(rows, "page int, id long, x0 double, y0 double, x1 double, y1 double, text string, left_right boolean, fontsize double")
    assert sorted(r.text for r in words.words(glyphs).collect()) == [" ", "ab", "cd"]
    assert sorted(r.text for r in words.words(glyphs, allow_space=True).collect()) == ["ab cd"]
    assert sorted(r.text for r in words.runs(glyphs, ["page"], "id").collect()) == ["ab", "cd"]


def test_table_edges(spark):
    from inkgrid.plans.queries import schedule_pages

    page = schedule_pages(spark.createDataFrame([(7,)], "s_suppkey long"))
    no_rect = page.filter(~F.col("is_rect"))
    assert tables.extract(no_rect, "door schedule").count() == 0
    assert tables.extract(page, "window schedule").count() == 0
    no_lines = page.filter((F.col("y0") != F.col("y1")) | F.col("text").isNotNull())
    assert tables.extract(no_lines, "door schedule").count() == 0
    cells = tables.extract(page, "door schedule")
    assert tables.symbol_column(cells).first()["col"] == 2


def test_scope_of_schedules(spark):
    marks = spark.createDataFrame([(1, p, p) for p in range(8)], "doc int, mark long, page int")
    schedules = spark.createDataFrame([(1, 20, 2), (1, 50, 5)], "doc int, sched long, page int")
    got = {r.page: r.sched for r in rules.in_force(marks, schedules, ["doc"], "page", "sched").collect()}
    assert got == {2: 20, 3: 20, 4: 20, 5: 50, 6: 50, 7: 50}
    same = {(r.page, r.sched) for r in rules.on_same_page(marks, schedules, ["doc"], "page").collect()}
    assert same == {(2, 20), (5, 50)}


def test_label_rules(spark):
    labels = spark.createDataFrame([(0, 1, "D1\n"), (0, 2, "A12 "), (0, 3, "D11"), (1, 4, "D1"), (0, 5, "")], "page int, id long, text string")
    rows = spark.createDataFrame([(0, 1, "D1"), (0, 2, "A##"), (0, 3, "")], "page int, rule_id long, row_id string")
    assert {(r.id, r.rule_id, r.label) for r in rules.label_matches(labels, rows, wildcard=True).collect()} == {(1, 1, "D1"), (2, 2, "A12")}


def test_shape_votes(spark):
    template = [(k, 0.0, 0.0, 10.0 + k, 3.0 * k) for k in range(5)]
    copies = [(0, 100 + k, x0 + 200, y0 + 100, x1 + 200, y1 + 100) for k, x0, y0, x1, y1 in template]
    part = [(0, 200 + k, x0 + 400, y0 + 300, x1 + 400, y1 + 300) for k, x0, y0, x1, y1 in template[:4]]
    lines = spark.createDataFrame(copies + part, BOX)
    shape = shapes.template_lines(spark.createDataFrame([("s", *r) for r in template], "shape string, id long, x0 double, y0 double, x1 double, y1 double"), "shape")
    found = shapes.found_shapes(shapes.votes(lines, shape, "shape"), "shape").collect()
    assert [(r.cell_x, r.cell_y) for r in found] == [(200, 100)]
    settled = shapes.strongest(shapes.found_shapes(shapes.settled_votes(shapes.votes(lines, shape, "shape"), "shape"), "shape"), "shape")
    assert settled.count() == 1


def test_progress(spark):
    rows = [("a", 0, 1, None, None), ("a", 1, 2, "bad", None), ("a", 2, None, None, True), ("b", 0, 5, None, None)]
    events = spark.createDataFrame(rows, "pdf_id string, seq long, curr_step long, msg string, success boolean").withColumn("ts", F.lit(0))
    got = {r.pdf_id: (r.curr_step, r.msg, r.success) for r in summary.latest(events, "pdf_id", ["curr_step", "msg", "success"]).collect()}
    assert got == {"a": (2, "bad", True), "b": (5, None, None)}
    pages = spark.createDataFrame([(1, p) for p in range(3)], "doc long, page long")
    assert progress.progress_events(pages).count() == 5


def test_stream_carries_schedules(spark, tmp_path):
    rows = [(1, 0, "mark", 1), (1, 1, "schedule", 10), (1, 2, "mark", 2), (2, 0, "mark", 3)]
    schema = "doc long, page long, kind string, id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out: list = []
    stream = progress.carry_schedules(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    progress.each_batch(stream, lambda df, k: out.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in out] == [(1, 2, 2, 10)]


def test_components_of_a_long_chain(spark):
    n = 300
    got = graph.components(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()
    assert len(got) == n and {r.component for r in got} == {0}


def test_reindex(spark):
    rows = [(0, 0, None), (0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 9)]
    elems = spark.createDataFrame(rows, "page int, elem_idx int, parent_idx int")
    got = {r.elem_idx: (r.new_idx, r.new_parent_idx) for r in boxes.reindex(elems, F.col("elem_idx") != 1, ["page"]).collect()}
    assert got == {0: (0, None), 2: (1, None), 3: (2, 1), 4: (3, None)}


def test_sources(spark, tmp_path):
    page = {"pdf_id": "p", "page_number": 2, "width": 100.0, "height": 50.0, "elems": [{"bbox": [0, 0, 5, 5], "text": "x"}, {"bbox": [1, 1, 2, 2], "linewidth": 1.0, "original_path": [{"op": "m", "pts": [{"x": 1, "y": 1}]}, {"op": "l", "pts": [{"x": 2, "y": 2}]}]}, {"bbox": [0, 0, 9, 9], "is_container": True}, {"bbox": [1]}]}
    (tmp_path / "pages.json").write_text(json.dumps(page))
    pages = elements.read_pages(spark, str(tmp_path / "pages.json"))
    elems = elements.elements(pages)
    assert elements.page_counts(pages).first()["num_pages"] == 1
    assert elements.read_pages(spark, str(tmp_path / "pages.json"), [7]).count() == 0
    assert sorted(r.kind for r in elems.collect()) == ["char", "curve"] and elements.elements(pages, containers=True).count() == 3
    nodes = elements.leaf_nodes(elems).collect()
    assert len(nodes) == 2 and {round(r.length, 3) for r in nodes} == {5.0, 1.414}
    (tmp_path / "symbols.json").write_text(json.dumps({"door": [{"bbox": [0, 0, 1, 1]}, {"bbox": [1, 1, 2, 2]}]}))
    assert elements.read_symbols(spark, str(tmp_path / "symbols.json")).count() == 2
    assert elements.cut_symbols(elems, {"all": (0, 0, 50, 50)}, most=1).first()["elements"][0]["text"] == "x"
    requests = spark.createDataFrame([('{"pdfId": "a"}',), ('{"pdfId": "a", "body": "{\\"pdfId\\": \\"b\\"}"}',), ("{",)], "event string")
    assert [r[0] for r in requests.select(elements.request_id()).collect()] == ["a", "b", None]
    (tmp_path / "plan.pdf").write_bytes(b"%PDF")
    assert elements.read_documents(spark, str(tmp_path / "plan.pdf")).select("pdf_id", "length").first() == ("plan", 4)


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "pdf_id string, summary string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "pdf_id string, summary string")
    changed = elements.update_summaries(old, new)
    assert sorted(map(tuple, changed.collect())) == [("a", "1"), ("b", "3")]
    elements.write_partitioned(old, str(tmp_path / "out"))
    elements.write_partitioned(changed.filter("pdf_id = 'b'"), str(tmp_path / "out"))
    assert sorted((r.pdf_id, r.summary) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "1"), ("b", "3")]
    elements.discard(old)
    assert elements.visible_to(old.withColumn("owner_id", F.col("pdf_id")), "a").count() == 1
    assert elements.with_defaults(old, {"n": F.lit(0)}).first()["n"] == 0
    assert boxes.differences(old, changed).count() == 2
    assert elements.as_json(old).count() == 2


def test_summary_documents(spark):
    rows = spark.createDataFrame([(1, "doors", 2, 0, ["D1"]), (1, "doors", 2, 1, ["D2"])], "doc int, schedule string, page int, row int, cells array<string>")
    matches = spark.createDataFrame([(1, "doors", 2, 0, "D1", 7)], "doc int, schedule string, page int, row int, label string, found_page int")
    out = json.loads(summary.schedules_document(rows, matches).first()["summary"])
    assert [len(r.get("elems", [])) for r in out["doors"]["2"]] == [1, 0]
    assert json.loads(spark.range(1).select(summary.empty_summary().alias("s")).first()["s"])["houseName"] == ""
    parts = spark.createDataFrame([("k", 0, "", [1]), ("k", 1, "x", [2]), ("k", 2, "", [3])], "k string, o int, s string, l array<int>")
    merged = summary.merged(parts, ["k"], "o", ["s"], ["l"]).first()
    assert merged.s == "x" and merged.l == [1, 2, 3]


def test_titles(spark):
    schema = "page int, id long, x0 double, y0 double, x1 double, y1 double, text string, page_width double"
    rows = [(0, 1, 900.0, 200.0, 990.0, 210.0, "Project Name:", 1000.0), (0, 2, 900.0, 180.0, 990.0, 190.0, "Smith House", 1000.0), (0, 3, 900.0, 160.0, 990.0, 170.0, "Owner: X", 1000.0), (0, 4, 900.0, 140.0, 990.0, 150.0, "Drawing Title", 1000.0), (0, 5, 900.0, 120.0, 990.0, 130.0, "A-1", 1000.0)]
    elems = spark.createDataFrame(rows, schema)
    assert summary.house_name(elems).first()["name"] == "Smith House"
    assert "A-1" not in summary.page_name(elems).first()["name"]


def test_set_distances_equal_the_expression(spark):
    from inkgrid.functions import geometry as g

    rnd = random.Random(6)
    line = lambda: tuple(float(rnd.randrange(20)) for _ in range(4))
    rows = [([line() for _ in range(rnd.randrange(4))], [line() for _ in range(rnd.randrange(4))]) for _ in range(60)]
    kind = f"array<{g.LINE}>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    native = [r.d for r in df.select(g.line_set_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    table = df.toArrow().combine_chunks()
    assert shapes.set_distances(table["a"].chunk(0), table["b"].chunk(0)).tolist() == pytest.approx(native)


def test_boxes_of_any_size_meet(spark):
    """Sizes from a point to the whole plane, infinite sides included: the grid joins equal a comparison of all pairs."""
    import random

    rnd = random.Random(4)
    far = float("inf")
    rows = [(1, k, *(lambda x, y, w: (x, y, x + w, y + w))(rnd.uniform(-9e3, 9e3), rnd.uniform(-9e3, 9e3), rnd.choice((0, 1, 60, 500, 5e3, 2e4)))) for k in range(80)]
    rows += [(1, 100, -far, 0.0, far, 10.0), (1, 101, 5.0, -far, 6.0, far), (1, 102, -far, -far, far, far), (1, 103, -1e12, -1e12, 1e12, 1e12)]
    boxes_ = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    meets = {(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    holds = {(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and a[2] <= b[2] and a[3] <= b[3] and a[4] >= b[4] and a[5] >= b[5]}
    got = spatial.intersection(boxes_, boxes_, extra=F.col("a_id") != F.col("b_id")).select("a_id", "b_id").collect()
    assert len(got) == len(meets) and {tuple(r) for r in got} == meets
    got = spatial.containment(boxes_, boxes_, extra=F.col("o_id") != F.col("i_id")).select("o_id", "i_id").collect()
    assert len(got) == len(holds) and {tuple(r) for r in got} == holds


def test_pen_starts_at_the_origin(spark):
    path = F.array(F.struct(F.lit("l").alias("op"), F.array(F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))).alias("pts")))
    line = spark.range(1).select(F.explode(g.path_lines(path)).alias("l")).first()["l"]
    assert tuple(line) == (0.0, 0.0, 3.0, 4.0)


def test_document_runs(spark):
    """Documents without tables have neither rows nor finds; the JSON holds every schedule, page and row."""
    from inkgrid.plans import document

    elems, curves = document.documents(spark.createDataFrame([(3,), (4,), (9,)], "s_suppkey long"))
    rows, found = document.run(elems.filter("doc <> 9 or page in (2, 8)"), curves, document.symbol_library(spark))
    got = {r.doc: json.loads(r.summary) for r in document.summary.schedules_document(rows, found.select("doc", "schedule", "page", "row", "found_page", "label")).collect()}
    assert got.keys() == {3, 4} and got[3].keys() == {"doors", "lighting"} and got[4].keys() == {"doors", "windows", "lighting"}
    assert got[4]["doors"].keys() == {"1", "7"} and [c["key"] for c in got[4]["windows"]["3"][0]["cells"]] == ["Mark", "Name", "Symbol"]
