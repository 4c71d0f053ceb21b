"""Queries over drawn pages: words, fractions, outlines and the layers that they form, each with SQL that derives the same from the elements.

The SQL sides know nothing of how a fixture was drawn: components and breadth-first levels come from recursion, greedy choices from
a walk through the ranked candidates of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composites, cycles, graph, layers, shapes, titles, words
from .queries import LENGTH, SLOPE, query, r6
from .views import dealt, view


def _meets(a: str, b: str) -> str:
    return f"{a}.x0 <= {b}.x1 AND {b}.x0 <= {a}.x1 AND {a}.y0 <= {b}.y1 AND {b}.y0 <= {a}.y1"


def _across(a: str, b: str) -> str:
    """Shared length across the reading direction."""
    return f"CASE WHEN {a}.left_right THEN greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) ELSE greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) END"


# words of glyphs

GLYPH_LINKS = f"""linked AS (SELECT a.page, a.id AS a, b.id AS b FROM v_glyphs a JOIN v_glyphs b ON a.page = b.page AND a.id <> b.id AND a.left_right = b.left_right AND abs(b.fontsize - a.fontsize) <= 1
      AND abs({_across('a', 'b')} - CASE WHEN a.left_right THEN a.y1 - a.y0 ELSE a.x1 - a.x0 END) <= 1
      AND CASE WHEN a.left_right THEN abs(b.x1 - a.x0) < 1 OR abs(b.x0 - a.x1) < 1 ELSE abs(b.y1 - a.y0) < 1 OR abs(b.y0 - a.y1) < 1 END)"""


def _clusters(name: str, nodes: str, links: str) -> str:
    """CTEs: `name` groups nodes by links that count both ways, as words.clustered does."""
    return f"""{name}_both AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    {name}_reached AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, l.b FROM {name}_reached r JOIN {name}_both l ON r.b = l.a),
    {name}_groups AS (SELECT a AS id, min(b) AS grp FROM {name}_reached GROUP BY a),
    {name}_items AS (SELECT n.*, grp, CASE WHEN left_right THEN x0 ELSE -y1 END AS place FROM {nodes} n JOIN {name}_groups USING (id)),
    {name} AS (SELECT page, grp AS id, string_agg(coalesce(text, ''), '' ORDER BY place, id) AS text, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, any_value(left_right) AS left_right,
      CASE WHEN any_value(left_right) THEN max(y1) - min(y0) ELSE max(x1) - min(x0) END AS fontsize FROM {name}_items GROUP BY page, grp)"""


WORDS = GLYPH_LINKS + ", " + _clusters("word", "v_glyphs", "linked")


def _glyphs(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(view(spark, sf, "v_glyphs"), "page")


@query(f", {GLYPH_LINKS} SELECT page, a, b FROM linked", "v_glyphs")
def glyph_links(spark: SparkSession, sf: str) -> DataFrame:
    return words.word_links(_glyphs(spark, sf), allow_space=True).select("page", "a", "b")


@query(f", {WORDS} SELECT page, id, text, n, x0, y0, x1, y1 FROM word", "v_glyphs")
def page_words(spark: SparkSession, sf: str) -> DataFrame:
    made = words.words(_glyphs(spark, sf), allow_space=True)
    return made.select("page", "id", "text", F.size("children").cast("bigint").alias("n"), "x0", "y0", "x1", "y1")


# texts whose boxes grow as they merge: the SQL adds one text after the other to the groups of its page

GROWN = """, scraps AS (SELECT *, CASE WHEN left_right THEN x1 - x0 ELSE y1 - y0 END / greatest(1, length(text)) AS m, row_number() OVER (PARTITION BY page, left_right ORDER BY id) AS k FROM v_scraps),
    many AS (SELECT page, left_right, count(*) AS n FROM scraps GROUP BY ALL),
    walk AS (SELECT page, left_right, 2 AS k, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'm': m, 'ids': [id]} AS now, CAST([] AS STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, m DOUBLE, ids BIGINT[])[]) AS kept, FALSE AS over FROM scraps WHERE k = 1
      UNION ALL SELECT page, left_right, CASE WHEN len(met) > 0 THEN k ELSE k + 1 END,
        CASE WHEN len(met) > 0 THEN {'x0': least(now.x0, list_min([h.x0 for h in met])), 'y0': least(now.y0, list_min([h.y0 for h in met])), 'x1': greatest(now.x1, list_max([h.x1 for h in met])), 'y1': greatest(now.y1, list_max([h.y1 for h in met])),
          'm': greatest(now.m, list_max([h.m for h in met])), 'ids': list_concat(now.ids, flatten([h.ids for h in met]))} ELSE {'x0': s0, 'y0': s1, 'x1': s2, 'y1': s3, 'm': sm, 'ids': [sid]} END,
        CASE WHEN len(met) > 0 THEN apart ELSE list_append(kept, now) END, len(met) = 0 AND sid IS NULL
      FROM (SELECT w.*, s.id AS sid, s.x0 AS s0, s.y0 AS s1, s.x1 AS s2, s.y1 AS s3, s.m AS sm, list_filter(kept, lambda h: TOUCH) AS met, list_filter(kept, lambda h: NOT (TOUCH)) AS apart
        FROM walk w LEFT JOIN scraps s ON s.page = w.page AND s.left_right = w.left_right AND s.k = w.k WHERE NOT over) t),
    grown AS (SELECT page, left_right, unnest(kept) AS h FROM walk WHERE over),
    member AS (SELECT page, left_right, list_min(h.ids) AS id, h.x0 AS x0, h.y0 AS y0, h.x1 AS x1, h.y1 AS y1, unnest(h.ids) AS member FROM grown)
    SELECT m.page, m.id, string_agg(text, '' ORDER BY CASE WHEN m.left_right THEN s.x0 ELSE s.y0 END, s.id) AS text, count(*) AS n, any_value(m.x0) AS x0, any_value(m.y0) AS y0, any_value(m.x1) AS x1, any_value(m.y1) AS y1, m.left_right
    FROM member m JOIN v_scraps s ON s.id = m.member GROUP BY m.page, m.id, m.left_right"""
_MX, _MY = "CASE WHEN w.left_right THEN greatest(now.m, h.m) ELSE 0 END", "CASE WHEN w.left_right THEN 0 ELSE greatest(now.m, h.m) END"
TOUCH = f"now.x0 - {_MX} <= h.x1 AND h.x0 <= now.x1 + {_MX} AND now.y0 - {_MY} <= h.y1 AND h.y0 <= now.y1 + {_MY}"


@query(GROWN.replace("TOUCH", TOUCH), "v_scraps")
def growing_words(spark: SparkSession, sf: str) -> DataFrame:
    return words.growing(dealt(view(spark, sf, "v_scraps"), "page"))


# fractions: the SQL walks through the ranked candidates of a page


def _middle(a: str, b: str) -> str:
    dx, dy = f"(({a}.x0 + {a}.x1) / 2 - ({b}.x0 + {b}.x1) / 2)", f"(({a}.y0 + {a}.y1) / 2 - ({b}.y0 + {b}.y1) / 2)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _apart(a: str, b: str) -> str:
    dx, dy = f"greatest(0.0, {a}.x0 - {b}.x1, {b}.x0 - {a}.x1)", f"greatest(0.0, {a}.y0 - {b}.y1, {b}.y0 - {a}.y1)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _toward(a: str, b: str) -> str:
    return f"degrees(atan2(({b}.y0 + {b}.y1) / 2 - ({a}.y0 + {a}.y1) / 2, ({b}.x0 + {b}.x1) / 2 - ({a}.x0 + {a}.x1) / 2))"


def _square(a: str, b: str) -> str:
    r = f"greatest({a}.x1 - {a}.x0, {a}.y1 - {a}.y0)"
    return f"{a}.x0 - {r} <= {b}.x1 AND {b}.x0 <= {a}.x1 + {r} AND {a}.y0 - {r} <= {b}.y1 AND {b}.y0 <= {a}.y1 + {r}"


def _fits(a: str) -> str:
    return f"abs(b.length - greatest({a}.x1 - {a}.x0, {a}.y1 - {a}.y0)) < greatest({a}.x1 - {a}.x0, {a}.y1 - {a}.y0)"


_OX, _OY = "((o.x0 + o.x1) / 2 - (n.x0 + n.x1) / 2)", "((o.y0 + o.y1) / 2 - (n.y0 + n.y1) / 2)"
FRACTIONS = f"""number AS (SELECT * FROM word WHERE regexp_full_match(text, '[0-9]+')),
    trio AS (SELECT n.page, n.id AS node, b.id AS bar, o.id AS other, {_apart('n', 'b')} AS to_bar, {_apart('n', 'o')} AS to_other, abs({_toward('n', 'o')} - {_toward('n', 'b')}) AS turn,
      CASE WHEN abs({_OY}) >= abs({_OX}) THEN (n.y0 + n.y1) / 2 > (o.y0 + o.y1) / 2 ELSE (n.x0 + n.x1) / 2 < (o.x0 + o.x1) / 2 END AS node_first
      FROM number n JOIN v_bars b ON n.page = b.page AND {_square('n', 'b')} JOIN number o ON n.page = o.page AND n.id <> o.id AND n.left_right = o.left_right AND abs(n.fontsize - o.fontsize) < 1 AND {_square('n', 'o')}
      WHERE ({_fits('n')} OR {_fits('o')}) AND {_middle('o', 'b')} < {_middle('o', 'n')}),
    candidate AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY node, to_bar, bar, to_other, other) AS k FROM trio WHERE CASE WHEN turn > 180 THEN 360 - turn ELSE turn END < 10),
    choice AS (SELECT page, k, [node, other] AS numbers, [bar] AS bars, [k] AS taken FROM candidate WHERE k = 1
      UNION ALL SELECT page, k, CASE WHEN free THEN list_concat(numbers, [node, other]) ELSE numbers END, CASE WHEN free THEN list_append(bars, bar) ELSE bars END, CASE WHEN free THEN list_append(taken, k) ELSE taken END
      FROM (SELECT w.page, c.k, node, other, bar, numbers, bars, taken, NOT list_contains(numbers, node) AND NOT list_contains(numbers, other) AND NOT list_contains(bars, bar) AS free FROM choice w JOIN candidate c ON c.page = w.page AND c.k = w.k + 1) t),
    chosen AS (SELECT page, unnest(taken) AS k FROM choice WHERE (page, k) IN (SELECT page, max(k) FROM candidate GROUP BY page)),
    matched AS (SELECT page, node, bar, other, node_first FROM candidate JOIN chosen USING (page, k)),
    parted AS (SELECT page, bar, CASE WHEN node_first THEN node ELSE other END AS top, CASE WHEN node_first THEN other ELSE node END AS low FROM matched),
    fraction AS (SELECT p.page, t.id, least(t.x0, l.x0, b.x0) AS x0, least(t.y0, l.y0, b.y0) AS y0, greatest(t.x1, l.x1, b.x1) AS x1, greatest(t.y1, l.y1, b.y1) AS y1, t.text || '/' || l.text AS text, t.left_right, top, low, bar
      FROM parted p JOIN word t ON p.top = t.id JOIN word l ON p.low = l.id JOIN v_bars b ON p.bar = b.id)"""


@query(f", {WORDS}, {FRACTIONS} SELECT page, node, bar, other, node_first FROM matched", "v_glyphs", "v_bars")
def page_fractions(spark: SparkSession, sf: str) -> DataFrame:
    made = words.words(_glyphs(spark, sf), allow_space=True).select("page", *words.NODE)
    return words.fractions(made, view(spark, sf, "v_bars"))


# phrases: the last layer of texts

LAYER2 = """second AS (SELECT page, id, x0, y0, x1, y1, text, left_right FROM word w WHERE NOT EXISTS (SELECT 1 FROM fraction f WHERE f.top = w.id OR f.low = w.id) UNION ALL SELECT page, id, x0, y0, x1, y1, text, left_right FROM fraction)"""
_WIDE = "a.x0 - CASE WHEN a.left_right THEN a.x1 - a.x0 ELSE 0 END <= b.x1 AND b.x0 <= a.x1 + CASE WHEN a.left_right THEN a.x1 - a.x0 ELSE 0 END AND a.y0 - CASE WHEN a.left_right THEN 0 ELSE a.y1 - a.y0 END <= b.y1 AND b.y0 <= a.y1 + CASE WHEN a.left_right THEN 0 ELSE a.y1 - a.y0 END"
_CENTRED = "CASE WHEN a.left_right THEN (a.y0 < b.y0 AND a.y1 > b.y1) OR (a.y0 > b.y0 AND a.y1 < b.y1) ELSE (a.x0 < b.x0 AND a.x1 > b.x1) OR (a.x0 > b.x0 AND a.x1 < b.x1) END"
PHRASES = f"""{LAYER2}, level AS (SELECT a.page, a.id AS a, b.id AS b FROM second a JOIN second b ON a.page = b.page AND a.id <> b.id AND a.left_right = b.left_right AND {_WIDE} AND {_CENTRED}
      AND {_across('a', 'b')} / CASE WHEN a.left_right THEN a.y1 - a.y0 ELSE a.x1 - a.x0 END > 0.25 AND (regexp_full_match(a.text, '[0-9]+/[0-9]+') OR regexp_full_match(b.text, '[0-9]+/[0-9]+'))), """ + _clusters("phrase", "second", "level")


@query(f", {WORDS}, {FRACTIONS}, {PHRASES} SELECT page, id, text, x0, y0, x1, y1 FROM phrase", "v_glyphs", "v_bars")
def page_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return words.phrases(_glyphs(spark, sf), view(spark, sf, "v_bars"), allow_space=True).select("page", "id", "text", "x0", "y0", "x1", "y1")


# outlines: levels and parents by recursion, cycles by climbing from both ends of each line that is no parent

CYCLES = """way AS (SELECT page, id, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM v_rings UNION ALL SELECT page, id, x1, y1, x0, y0 FROM v_rings),
    reach AS (SELECT DISTINCT page, ax, ay, ax AS rx, ay AS ry FROM way UNION SELECT r.page, r.ax, r.ay, e.bx, e.by_ FROM reach r JOIN way e ON e.page = r.page AND e.ax = r.rx AND e.ay = r.ry),
    root AS (SELECT page, ax, ay, min({'x': rx, 'y': ry}) AS r FROM reach GROUP BY page, ax, ay),
    wave AS (SELECT page, ax AS x, ay AS y, 0 AS d FROM root WHERE r.x = ax AND r.y = ay UNION SELECT e.page, e.bx, e.by_, d + 1 FROM wave w JOIN way e ON e.page = w.page AND e.ax = w.x AND e.ay = w.y WHERE d < 30),
    depth AS (SELECT page, x, y, min(d) AS d FROM wave GROUP BY page, x, y),
    parent_id AS (SELECT e.page, e.bx AS x, e.by_ AS y, min(e.id) AS id FROM way e JOIN depth a ON a.page = e.page AND a.x = e.ax AND a.y = e.ay JOIN depth b ON b.page = e.page AND b.x = e.bx AND b.y = e.by_ WHERE b.d = a.d + 1 GROUP BY ALL),
    parent AS (SELECT p.*, e.ax AS px, e.ay AS py FROM parent_id p JOIN way e ON e.page = p.page AND e.id = p.id AND e.bx = p.x AND e.by_ = p.y),
    closing AS (SELECT * FROM v_rings r WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.page = r.page AND p.id = r.id)),
    climb AS (SELECT page, id AS c, 1 AS side, 0 AS step, x1 AS x, y1 AS y FROM closing UNION ALL SELECT page, id, 0, 0, x0, y0 FROM closing
      UNION ALL SELECT k.page, c, side, step + 1, px, py FROM climb k JOIN parent p ON p.page = k.page AND p.x = k.x AND p.y = k.y),
    alone AS (SELECT * FROM climb k WHERE NOT EXISTS (SELECT 1 FROM climb o WHERE o.page = k.page AND o.c = k.c AND o.side <> k.side AND o.x = k.x AND o.y = k.y)),
    sides AS (SELECT page, c, count(*) FILTER (WHERE side = 1) AS ups, count(*) FILTER (WHERE side = 0) AS downs FROM alone GROUP BY page, c),
    walked AS (SELECT page, id AS c, 0 AS pos, id, x1 - x0 AS dx, y1 - y0 AS dy FROM closing
      UNION ALL SELECT a.page, a.c, CASE WHEN side = 1 THEN step + 1 ELSE ups + downs - step END, p.id, CASE WHEN side = 1 THEN px - a.x ELSE a.x - px END, CASE WHEN side = 1 THEN py - a.y ELSE a.y - py END
      FROM alone a JOIN sides USING (page, c) JOIN parent p ON p.page = a.page AND p.x = a.x AND p.y = a.y),
    turned AS (SELECT *, count(*) OVER w AS n, abs(degrees(atan2(dy, dx)) - degrees(atan2(lead(dy) OVER o, lead(dx) OVER o))) AS turn, abs(degrees(atan2(dy, dx)) - degrees(atan2(first_value(dy) OVER o, first_value(dx) OVER o))) AS back FROM walked WINDOW w AS (PARTITION BY page, c), o AS (PARTITION BY page, c ORDER BY pos)),
    bent AS (SELECT page, c, n, id, CASE WHEN turn > 180 THEN 360 - turn ELSE turn END AS t, CASE WHEN coalesce(turn, back) > 180 THEN 360 - coalesce(turn, back) ELSE coalesce(turn, back) END AS whole FROM turned),
    cycle AS (SELECT page, c, any_value(n) AS n, list_sort(list(id)) AS ids, max(least(t, 180 - t)) AS sharpest, sum(whole) AS around FROM bent GROUP BY page, c),
    outline AS (SELECT page, 'circle' AS kind, n, ids FROM cycle WHERE n > 5 AND sharpest <= 20 UNION ALL SELECT page, 'hexagon', n, ids FROM cycle WHERE n = 6 AND abs(around - 360) < 1)"""


@query(f", {CYCLES} SELECT page, kind, n, ids[1] AS first_id, ids[-1] AS last_id FROM outline", "v_rings")
def ring_outlines(spark: SparkSession, sf: str) -> DataFrame:
    found = cycles.outlines(view(spark, sf, "v_rings"))
    return found.select("page", "kind", F.col("n").cast("bigint").alias("n"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"))


@query(
    """, met AS (SELECT a.page, a.id AS a_id, b.id AS b_id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
      (a.x0 - a.x1) * (b.y0 - b.y1) - (b.x0 - b.x1) * (a.y0 - a.y1) AS k, a.x0 * a.y1 - a.y0 * a.x1 AS da, b.x0 * b.y1 - b.y0 * b.x1 AS db
      FROM v_segments a JOIN v_segments b ON a.page = b.page AND a.id < b.id),
    q AS (SELECT *, (da * (bx0 - bx1) - (ax0 - ax1) * db) / k AS px, (da * (by0 - by1) - (ay0 - ay1) * db) / k AS py FROM met WHERE k <> 0),
    p AS (SELECT * FROM q WHERE px BETWEEN least(ax0, ax1) - 0.1 AND greatest(ax0, ax1) + 0.1 AND py BETWEEN least(ay0, ay1) - 0.1 AND greatest(ay0, ay1) + 0.1
      AND px BETWEEN least(bx0, bx1) - 0.1 AND greatest(bx0, bx1) + 0.1 AND py BETWEEN least(by0, by1) - 0.1 AND greatest(by0, by1) + 0.1),
    points AS (SELECT page, a_id AS id, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py FROM p UNION SELECT page, b_id, round(px, 6) + 0.0, round(py, 6) + 0.0 FROM p UNION SELECT page, id, x0, y0 FROM v_segments UNION SELECT page, id, x1, y1 FROM v_segments),
    placed AS (SELECT t.*, (px - x0) * (x1 - x0) + (py - y0) * (y1 - y0) AS along FROM points t JOIN v_segments s ON s.page = t.page AND s.id = t.id),
    pieces AS (SELECT page, id, lag(px) OVER o AS x0, lag(py) OVER o AS y0, px AS x1, py AS y1, row_number() OVER o - 1 AS piece FROM placed WINDOW o AS (PARTITION BY page, id ORDER BY along, px, py))
    SELECT page, id, piece, x0, y0, x1, y1 FROM pieces WHERE piece > 0""",
    "v_segments",
)
def cut_lines(spark: SparkSession, sf: str) -> DataFrame:
    return cycles.cut_at_crossings(dealt(view(spark, sf, "v_segments"), "id"))


# all layers

SHAPES_FOUND = f"""f AS (SELECT id, ring, page, {SLOPE} AS slope, {LENGTH} AS length, x0, y0, x1, y1, least(x0, x1) AS lx, least(y0, y1) AS ly FROM v_rings),
    tpl AS (SELECT ring AS shape, id AS line_id, slope, length, lx - min(lx) OVER w AS off_x, ly - min(ly) OVER w AS off_y, count(*) OVER w AS n_lines FROM f WINDOW w AS (PARTITION BY ring)),
    voted AS (SELECT f.page, CAST(floor(f.lx - off_x) AS BIGINT) AS cell_x, CAST(floor(f.ly - off_y) AS BIGINT) AS cell_y, shape, line_id, n_lines, f.id AS node_id,
      least(1 - tanh(abs(f.slope - tpl.slope)), 1 - tanh(abs(f.length - tpl.length) / greatest(f.length, tpl.length, 0.001))) AS activation
      FROM f JOIN tpl ON abs(f.slope - tpl.slope) <= 0.1 AND abs(f.length - tpl.length) <= 0.5),
    elected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, cell_x, cell_y, shape, line_id ORDER BY activation DESC, node_id) AS k FROM voted WHERE activation > 0.8) WHERE k = 1),
    shape AS (SELECT e.page, cell_x, cell_y, shape, list_sort(list_distinct(list(node_id))) AS ids, min(lx) AS x0, min(ly) AS y0, max(greatest(f.x0, f.x1)) AS x1, max(greatest(f.y0, f.y1)) AS y1
      FROM elected e JOIN f ON f.page = e.page AND f.id = e.node_id GROUP BY e.page, cell_x, cell_y, shape HAVING sum(activation) / any_value(n_lines) > 0.9)"""


def _children(kind: str, ids: str) -> str:
    return f"array_to_string(list_transform({ids}, lambda i: '{kind}:' || i), ',')"


LAYERS = f"""frame AS (SELECT o.page, o.kind, o.kind || ':' || ids[1] AS node, o.ids, min(least(x0, x1)) AS x0, min(least(y0, y1)) AS y0, max(greatest(x0, x1)) AS x1, max(greatest(y0, y1)) AS y1
      FROM outline o JOIN v_rings r ON r.page = o.page AND list_contains(o.ids, r.id) GROUP BY ALL),
    word_glyphs AS (SELECT grp, list_sort(list(id)) AS ids FROM word_items GROUP BY grp),
    inside AS (SELECT f.page, f.node, f.x0, f.y0, f.x1, f.y1, string_agg(w.text, '' ORDER BY w.x0, w.id) AS text, list('word:' || w.id) AS held FROM frame f JOIN word w ON w.page = f.page AND f.x0 <= w.x0 AND f.y0 <= w.y0 AND f.x1 >= w.x1 AND f.y1 >= w.y1 GROUP BY ALL),
    phrase_parts AS (SELECT grp, array_to_string(list_sort(list(CASE WHEN id IN (SELECT id FROM fraction) THEN 'fraction:' ELSE 'word:' END || id)), ',') AS held FROM phrase_items GROUP BY grp HAVING count(*) > 1)
    SELECT page, 1 AS layer, kind, node, NULL AS name, x0, y0, x1, y1, {_children('line', 'ids')} AS children FROM frame
    UNION ALL SELECT page, 1, 'shape', 'shape:' || shape || ':' || cell_x || ':' || cell_y, CAST(shape AS VARCHAR), x0, y0, x1, y1, {_children('line', 'ids')} FROM shape
    UNION ALL SELECT page, 1, 'word', 'word:' || id, text, x0, y0, x1, y1, array_to_string(list_transform(ids, lambda i: 'glyph:' || i), ',') FROM word JOIN word_glyphs ON id = grp
    UNION ALL SELECT page, 2, 'fraction', 'fraction:' || id, text, x0, y0, x1, y1, array_to_string(list_sort(['word:' || top, 'word:' || low, 'line:' || bar]), ',') FROM fraction
    UNION ALL SELECT page, 2, 'label', 'label:' || node, text, x0, y0, x1, y1, array_to_string(list_sort(list_append(held, node)), ',') FROM inside
    UNION ALL SELECT page, 3, 'phrase', 'phrase:' || id, text, x0, y0, x1, y1, held FROM phrase JOIN phrase_parts ON id = grp"""


def _activated(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "v_rings")
    return layers.activate(lines, _glyphs(spark, sf), view(spark, sf, "v_bars"), shapes.template_lines(lines, "ring"), "ring")


@query(f", {WORDS}, {FRACTIONS}, {PHRASES}, {CYCLES}, {SHAPES_FOUND}, {LAYERS}", "v_glyphs", "v_bars", "v_rings")
def layer_activation(spark: SparkSession, sf: str) -> DataFrame:
    return _activated(spark, sf).withColumn("children", F.array_join("children", ","))


# rooms

_TOKENS = """regexp_extract_all(part, '[0-9]+/[0-9]+|[0-9]*\\.[0-9]+|[0-9]+|''|"|feet|foot|ft|inches|inch|in')"""
ROOMS = f"""bounds AS (SELECT b.page, b.id, max(s.x0) FILTER (WHERE s.x0 = s.x1 AND least(s.y0, s.y1) <= b.y0 AND greatest(s.y0, s.y1) >= b.y1 AND s.x0 < b.x0) AS x0, max(s.y0) FILTER (WHERE s.y0 = s.y1 AND least(s.x0, s.x1) <= b.x0 AND greatest(s.x0, s.x1) >= b.x1 AND s.y0 < b.y0) AS y0,
      min(s.x1) FILTER (WHERE s.x0 = s.x1 AND least(s.y0, s.y1) <= b.y0 AND greatest(s.y0, s.y1) >= b.y1 AND s.x1 > b.x1) AS x1, min(s.y1) FILTER (WHERE s.y0 = s.y1 AND least(s.x0, s.x1) <= b.x0 AND greatest(s.x0, s.x1) >= b.x1 AND s.y1 > b.y1) AS y1
      FROM v_room_texts b JOIN v_room_lines s ON s.page = b.page WHERE regexp_matches(b.text, '^[0-9]') GROUP BY b.page, b.id),
    room AS (SELECT b.page, b.id, string_agg(t.text, '' ORDER BY t.x0, t.id) AS text FROM bounds b JOIN v_room_texts t ON t.page = b.page AND b.x0 <= t.x0 AND b.y0 <= t.y0 AND b.x1 >= t.x1 AND b.y1 >= t.y1 GROUP BY b.page, b.id),
    part AS (SELECT page, id, nth, part, list_transform({_TOKENS}, lambda t: {{'v': CASE WHEN contains(t, '/') THEN try_cast(split_part(t, '/', 1) AS DOUBLE) / try_cast(split_part(t, '/', 2) AS DOUBLE) ELSE coalesce(try_cast(t AS DOUBLE), 0) END,
      'u': CASE WHEN t IN (chr(39), 'feet', 'foot', 'ft') THEN 1.0::DOUBLE WHEN t IN ('"', 'inches', 'inch', 'in') THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END, 'total': 0.0::DOUBLE}}) AS tokens
      FROM (SELECT page, id, unnest(regexp_split_to_array(lower(text), 'x|by')) AS part, generate_subscripts(regexp_split_to_array(lower(text), 'x|by'), 1) AS nth FROM room) s),
    measure AS (SELECT page, id, nth, list_reduce(list_prepend({{'v': 0.0::DOUBLE, 'u': 0.0::DOUBLE, 'total': 0.0::DOUBLE}}, tokens), lambda s, t: {{'v': CASE WHEN t.u > 0 THEN 0.0::DOUBLE ELSE s.v + t.v END, 'u': 0.0::DOUBLE, 'total': CASE WHEN t.u > 0 THEN s.total + s.v / t.u ELSE s.total END}}) AS f
      FROM part WHERE regexp_matches(part, '[0-9]')),
    sized AS (SELECT page, id, list(f.total + f.v ORDER BY nth) AS sizes FROM measure GROUP BY page, id)
    SELECT r.page, r.id, text, round(sizes[1] * sizes[2], 6) AS area FROM room r LEFT JOIN sized s USING (page, id)"""


@query(", " + ROOMS, "v_room_lines", "v_room_texts")
def room_areas(spark: SparkSession, sf: str) -> DataFrame:
    texts = view(spark, sf, "v_room_texts")
    labels = texts.filter(F.col("text").rlike("^[0-9]"))
    return composites.room_areas(labels.select("page", "id", "x0", "y0", "x1", "y1"), view(spark, sf, "v_room_lines"), texts).withColumn("area", r6(F.col("area")))


@query(
    """, cell AS (SELECT id, json_extract_string(data, '$.ceiling') AS finish FROM v_facts WHERE elem_type = 'schedule_cell'), facts AS (SELECT id, json_extract_string(data, '$.name_of_room') AS room FROM v_facts WHERE elem_type = 'schedule_row'),
    finishes AS (SELECT DISTINCT finish, room FROM v_fact_links l JOIN cell c ON l.from_id = c.id JOIN facts r ON l.to_id = r.id WHERE finish IS NOT NULL),
    areas AS (SELECT json_extract_string(data, '$.name_of_room') AS room, sum(CAST(json_extract_string(data, '$.square_feet') AS DOUBLE)) AS area FROM v_facts WHERE elem_type = 'square_feet' GROUP BY ALL)
    SELECT finish, count(*) AS rooms, sum(area) AS square_feet FROM areas LEFT JOIN finishes USING (room) GROUP BY finish""",
    "v_facts", "v_fact_links",
)
def graph_room_area(spark: SparkSession, sf: str) -> DataFrame:
    return graph.area_by_finish(view(spark, sf, "v_facts"), view(spark, sf, "v_fact_links"), "ceiling")


@query(
    """, corner AS (SELECT doc, page, string_agg(text, ' ' ORDER BY y0 DESC, id) AS name FROM v_titles WHERE x0 >= page_width - 251 AND x1 <= page_width AND y0 >= 0 AND y1 <= 288 AND parent IS NULL AND NOT regexp_matches(replace(lower(text), chr(10), ''), '[a-zA-Z]-[0-9][0-9]?') AND replace(lower(text), chr(10), '') NOT IN ('drawing title', 'drawing number') GROUP BY doc, page),
    anchor AS (SELECT * FROM v_titles WHERE regexp_matches(lower(text), '^project name.{0,2}') AND x0 / page_width >= 0.8 AND y0 / page_height <= 0.4),
    below AS (SELECT a.doc, a.page, a.id AS anchor, t.id, t.y0, t.text, contains(lower(t.text), 'drawing title') AS title FROM anchor a JOIN v_titles t ON a.doc = t.doc AND a.page = t.page AND t.parent IS NULL AND t.x0 >= a.x0 - 10 AND t.x1 <= a.page_width AND t.y0 >= 0 AND t.y1 <= a.y0),
    scan AS (SELECT *, row_number() OVER w AS nth, bool_or(title) OVER w AS ended, bool_or(title) OVER (PARTITION BY doc, page, anchor) AS any_title FROM below WINDOW w AS (PARTITION BY doc, page, anchor ORDER BY y0 DESC, id ROWS UNBOUNDED PRECEDING)),
    house AS (SELECT a.doc, a.page, a.id AS anchor, coalesce(trim(string_agg(replace(s.text, chr(10), ' '), '' ORDER BY s.y0 DESC, s.id)), '') AS name FROM anchor a LEFT JOIN scan s ON s.doc = a.doc AND s.page = a.page AND s.anchor = a.id AND NOT ended AND (any_title OR nth <= 3) AND NOT starts_with(lower(s.text), 'owner') GROUP BY ALL),
    last AS (SELECT doc, arg_max(name, (page, anchor)) AS house_name FROM house GROUP BY doc)
    SELECT p.doc, p.page, coalesce(replace(trim(name), chr(10), ' '), '') AS page_name, house_name FROM (SELECT DISTINCT doc, page FROM v_titles) p LEFT JOIN corner c ON c.doc = p.doc AND c.page = p.page LEFT JOIN last l ON l.doc = p.doc""",
    "v_titles",
)
def document_titles(spark: SparkSession, sf: str) -> DataFrame:
    return titles.document_titles(view(spark, sf, "v_titles"))
