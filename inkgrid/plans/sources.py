"""Queries that run the sources, sinks and small page questions over data derived from the tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes, composites, cycles, graph, rules, spatial
from ..sources import elements
from ..streaming import progress
from .pages import CYCLES
from .queries import _event_stream, _fed, query, r6
from .views import base, view

#: One page of element JSON for each fifty parts: texts, lines with a path, containers and annotations, some fields missing.
ELEMENTS = """
SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS doc, CAST(floor(p_partkey % 200 / 50) AS INT) AS page, p_partkey % 50 AS nth, p_partkey, p_size, p_name FROM part"""


def pages_json(spark: SparkSession, sf: str) -> DataFrame:
    """(json): a text for each page, as a producer of element JSON writes it."""
    base(spark, sf, "part").createOrReplaceTempView("part")
    e = spark.sql(ELEMENTS)
    k, x, y = F.col("p_partkey"), (F.col("nth") * 10).cast("double"), F.col("p_size").cast("double")
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    path = F.array(F.struct(F.lit("m").alias("op"), F.array(point(x, y)).alias("pts")), F.struct(F.lit("l").alias("op"), F.array(point(x + 5, y + 2)).alias("pts")), F.struct(F.lit("l").alias("op"), F.array(point(x, y)).alias("pts")))
    kind = k % 5
    element = F.struct(
        F.when(kind == 4, F.array(x)).otherwise(F.array(x, y, x + 5, y + 2)).alias("bbox"),
        F.when(kind == 0, F.col("p_name")).alias("text"),
        F.when(kind == 1, path).alias("original_path"),
        F.when(kind == 1, (k % 3).cast("double")).alias("linewidth"),
        F.when(kind == 2, F.lit(True)).alias("is_container"),
        F.when((kind == 0) & (k % 7 == 0), F.lit(True)).alias("is_annotation"),
        F.when((kind == 0) & (k % 2 == 0), F.lit(False)).alias("upright"),
    )
    pages = e.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("nth", element.alias("e")))).alias("es"))
    return pages.select(F.to_json(F.struct(F.col("doc").cast("string").alias("pdf_id"), F.col("page").alias("page_number"), F.lit(500.0).alias("width"), F.lit(100.0).alias("height"), F.transform("es", lambda v: v["e"]).alias("elems"))).alias("json"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_json(spark, sf).select(F.from_json("json", elements.PAGE).alias("p")).select("p.*")


_E = f"e AS ({ELEMENTS}), k AS (SELECT *, p_partkey % 5 AS kind FROM e)"


@query(f"WITH {_E} SELECT CAST(doc AS VARCHAR) AS pdf_id, page AS page_number, CAST(nth AS INT) AS elem_idx, nth * 10.0 AS x0, CAST(p_size AS DOUBLE) AS y0, 5.0 AS width, 2.0 AS height, CASE WHEN kind = 0 THEN p_name END AS text, CASE WHEN kind = 1 THEN p_partkey % 3 ELSE 0 END::DOUBLE AS linewidth, NOT (kind = 0 AND p_partkey % 2 = 0) AS upright, CASE kind WHEN 0 THEN 'char' ELSE 'curve' END AS kind FROM k WHERE kind IN (0, 1, 3) AND NOT (kind = 0 AND p_partkey % 7 = 0)")
def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Element JSON flattened: broken boxes, containers and annotations left out, defaults filled in."""
    return elements.elements(_pages(spark, sf)).select("pdf_id", "page_number", "elem_idx", "x0", "y0", "width", "height", "text", "linewidth", "upright", "kind")


@query(
    f"""WITH {_E} SELECT CAST(doc AS VARCHAR) AS pdf_id, page AS page_number, CAST(nth AS INT) AS elem_idx, -1 AS seg_idx, nth * 10.0 AS x0, CAST(p_size AS DOUBLE) AS y0, nth * 10 + 5.0 AS x1, p_size + 2.0 AS y1, p_name AS text, NOT (p_partkey % 2 = 0) AS left_right, CASE WHEN p_partkey % 2 = 0 THEN 2.0 ELSE 5.0 END::DOUBLE AS length FROM k WHERE kind = 0 AND p_partkey % 7 <> 0
    UNION ALL SELECT CAST(doc AS VARCHAR), page, CAST(nth AS INT), s, nth * 10.0, CAST(p_size AS DOUBLE), nth * 10 + 5.0, p_size + 2.0, NULL, TRUE, round(sqrt(29.0::DOUBLE), 6) FROM k, (VALUES (0), (1)) t(s) WHERE kind = 1 AND p_partkey % 3 > 0"""
)
def page_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of layer 0: glyphs, and the lines of drawn paths."""
    nodes = elements.leaf_nodes(elements.elements(_pages(spark, sf)))
    return nodes.select("pdf_id", "page_number", "elem_idx", "seg_idx", "x0", "y0", "x1", "y1", "text", "left_right", r6(F.col("length")).alias("length"))


@query(f"WITH {_E} SELECT CAST(doc AS VARCHAR) AS pdf_id, count(DISTINCT page) AS num_pages FROM k GROUP BY doc")
def page_counts(spark: SparkSession, sf: str) -> DataFrame:
    return elements.page_counts(_pages(spark, sf))


@query(
    f"""WITH {_E}, cut AS (SELECT * FROM (VALUES ('left', 0, 100), ('right', 300, 420)) t(name, low, high)),
    inside AS (SELECT name, doc, page, nth, p_name, row_number() OVER (PARTITION BY name ORDER BY nth, doc, page) AS k FROM k JOIN cut ON nth * 10 >= low AND nth * 10 + 5 <= high AND p_size + 2 <= 40 WHERE kind = 0 AND p_partkey % 7 <> 0)
    SELECT name, count(*) AS n, min(nth) AS first_idx, max(nth) AS last_idx FROM inside GROUP BY name"""
)
def symbol_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Glyphs inside named boxes of all pages, cut out as symbols."""
    glyphs = elements.elements(_pages(spark, sf)).filter(F.col("kind") == "char")
    cut = elements.cut_symbols(glyphs, {"left": (0.0, 0.0, 100.0, 40.0), "right": (300.0, 0.0, 420.0, 40.0)})
    idx = F.transform("elements", lambda v: v["elem_idx"])
    return cut.select("name", F.size("elements").cast("bigint").alias("n"), F.array_min(idx).cast("bigint").alias("first_idx"), F.array_max(idx).cast("bigint").alias("last_idx"))


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'q' || c_custkey WHEN 2 THEN NULL ELSE 'b' || c_custkey END AS pdf_id FROM customer"""
)
def request_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The document that requests ask for: in a JSON body, in the request, in none (broken JSON), in a body that is text."""
    c = base(spark, sf, "customer")
    inner = F.concat(F.lit('{\\"pdfId\\": \\"b'), F.col("c_custkey").cast("string"), F.lit('\\"}'))
    event = F.concat(
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('{"pdfId": "no", "body": {"pdfId": "'), "c_name", F.lit('"}}')))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('{"pdfId": "q'), F.col("c_custkey").cast("string"), F.lit('"}')))
        .when(F.col("c_custkey") % 4 == 2, F.lit('{"pdfId": '))
        .otherwise(F.concat(F.lit('{"body": "'), inner, F.lit('"}')))
    )
    return c.select(F.col("c_custkey").alias("id"), elements.request_id(event).alias("pdf_id"))


@query(
    """SELECT s_suppkey AS pdf_id, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE CASE WHEN s_suppkey % 5 > 0 THEN s_name END END, '{}') AS summary, CAST(s_nationkey AS VARCHAR) AS owner_id, 'unknown' AS house_name FROM supplier WHERE s_nationkey < 13"""
)
def summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries updated by key, with the table's defaults, as the owners with small numbers see them."""
    s = base(spark, sf, "supplier")
    old = s.select(F.col("s_suppkey").alias("pdf_id"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).alias("summary"), F.col("s_nationkey").cast("string").alias("owner_id"))
    new = s.filter(F.col("s_suppkey") % 3 == 0).select(F.col("s_suppkey").alias("pdf_id"), F.concat(F.lit("new "), "s_name").alias("summary"))
    new = new.unionByName(spark.range(1).select((-F.col("id") - 1).alias("pdf_id"), F.lit("nobody's").alias("summary")))  # no row to update
    filled = elements.with_defaults(elements.update_summaries(old, new), {"summary": F.lit("{}"), "house_name": F.lit("unknown")})
    out = None
    for user in range(13):
        seen = elements.visible_to(filled, str(user))
        out = seen if out is None else out.unionByName(seen)
    return out.select("pdf_id", "summary", "owner_id", "house_name")


@query(
    """WITH a AS (SELECT p_partkey AS id, p_name AS text FROM part UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 = 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS text FROM part WHERE p_partkey % 11 > 0)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)
def result_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that two results do not share, repeated rows counted."""
    part = base(spark, sf, "part")
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    b = part.filter(F.col("p_partkey") % 11 > 0).select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("text"))
    return boxes.differences(a.unionByName(a.filter(F.col("id") % 10 == 0)), b)


@query(
    """WITH p AS (SELECT DISTINCT o_custkey AS doc, o_orderkey % 50 AS page FROM orders), n AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS nth, count(*) OVER (PARTITION BY doc) + 1 AS total FROM p), d AS (SELECT DISTINCT doc, total FROM n)
    SELECT doc AS pdf_id, 0 AS seq, 0 AS curr_step, total AS total_steps, 'start' AS msg, NULL::BOOLEAN AS success FROM d UNION ALL SELECT doc, nth, nth, NULL, 'page', NULL FROM n UNION ALL SELECT doc, total, NULL, NULL, 'done', TRUE FROM d"""
)
def progress_written(spark: SparkSession, sf: str) -> DataFrame:
    """The events that a run over documents writes: a start, one for each page, a done."""
    pages = base(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 50).alias("page"))
    return progress.progress_events(pages)


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a stream in tumbling windows behind a watermark, merged by window; the input at hand is one batch, so none is late."""
    counted = progress.windowed_counts(_event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return _fed(spark, counted, ["start", "event_type"]).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query(f", {CYCLES} SELECT page, count(*) AS n, min(id) AS first_id FROM v_rings r WHERE NOT EXISTS (SELECT 1 FROM outline o WHERE o.page = r.page AND list_contains(o.ids, r.id)) GROUP BY page", "v_rings")
def lines_left(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that no circle or hexagon uses, by page."""
    lines = graph.stored(view(spark, sf, "v_rings"), "rings")
    return cycles.unused_lines(lines, cycles.outlines(lines)).groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    """, r AS (SELECT s_suppkey AS row_id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT m.id, m.text, r.name, regexp_matches(m.text, '^' || left(r.name, 1)) AS starts FROM (SELECT p_partkey AS id, p_name AS text, CAST(floor(p_partkey / 20) AS BIGINT) AS row_id FROM part) m JOIN r ON m.row_id = r.row_id""",
    "v_boxes",
)
def row_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Results with the schedule row that they point to, tested by a pattern made from the row."""
    rows = base(spark, sf, "supplier").filter(F.col("s_suppkey") % 2 == 0).select(F.col("s_suppkey").alias("row"), F.col("s_name").alias("row_id"))
    made = rules.regex_rule(lambda c: F.concat(F.lit("^"), F.substring(c, 1, 1)), rows)
    found = base(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.floor(F.col("p_partkey") / 20).cast("bigint").alias("row"))
    return rules.attach(found, made, ["row"]).select("id", "text", F.col("row_id").alias("name"), F.expr("regexp_like(text, pattern)").alias("starts"))


@query(", w AS (SELECT * FROM v_boxes WHERE x0 >= 200 AND y0 >= 100 AND x1 <= 600 AND y1 <= 500) SELECT page, id, grp FROM w WHERE grp IN ('Brand#1', 'Brand#2', 'Brand#3') AND id IN (SELECT l_partkey FROM lineitem)", "v_boxes")
def boxes_of_list(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes inside a literal box, of a list of groups, that a list of ids names."""
    inside = rules.inside_box(view(spark, sf, "v_boxes"), (200.0, 100.0, 600.0, 500.0))
    ids = base(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return composites.projected(graph.members(inside, "grp", ["Brand#1", "Brand#2", "Brand#3"]), ids, ["id"]).select("page", "id", "grp")


@query(
    """, f AS (SELECT page, id, x0, y0, x1, y1 FROM v_segments),
    s AS (SELECT page, id, CAST(greatest(1, ceil(greatest(abs(x1 - x0), abs(y1 - y0)) / 8)) AS INT) AS n, x0, y0, x1, y1 FROM f)
    SELECT DISTINCT page, id, CAST(floor((x0 + (x1 - x0) * k / n) / 8) AS INT) AS cx, CAST(floor((y0 + (y1 - y0) * k / n) / 8) AS INT) AS cy FROM (SELECT *, unnest(range(n + 1)) AS k FROM s) t""",
    "v_segments",
)
def raster_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cells that every segment passes."""
    return spatial.rasterised(view(spark, sf, "v_segments"), 8.0)
