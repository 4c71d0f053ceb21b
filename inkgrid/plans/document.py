"""The run over whole documents: schedules, the rules they put in force, labels, shapes near them, and the summary.

Every kind of rule in RULES is compiled to one plan over all pages of all documents: tables to rows, rows to rules, rules to the
pages where they are in force, labels to matches, matches to the first group of shapes that all lie near the label.  All joins are
equi-joins by document and page (grid joins for boxes), so documents run side by side and none is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes, rules, shapes, summary, tables
from ..operators.graph import shuffled, stored
from .queries import query
from .views import base, dealt

KEY = ["doc", "page"]
#: Fixed value: how far a curve may lie from a symbol's to be the same shape.
NEAR = 2.0
#: How far around a label its symbol is looked for.
REACH = 20.0


def schedule_rows(found: tables.Grid, kind: rules.RuleKind) -> DataFrame:
    """(doc, schedule, page, row, cells, row_id) of the tables of a kind; cells are (key, label), the first is the row's id."""
    cells = tables.with_headers(tables.extracted(found), found.by)
    items = F.array_sort(F.collect_list(F.struct("col", "key", F.col("text").alias("label"))))
    row = cells.groupBy(*found.by, "row").agg(items.alias("items"), F.max(F.when(F.col("col") == 0, F.col("text"))).alias("row_id"))
    return row.select("doc", F.lit(kind.schedule).alias("schedule"), "page", "row", F.transform("items", lambda c: F.struct(c["key"].alias("key"), c["label"].alias("label"))).alias("cells"), "row_id")


def scope(elems: DataFrame, found: tables.Grid, kind: rules.RuleKind) -> DataFrame:
    """(doc, page, schedule_page): the schedule that is in force on each page, its own included; only there for kinds that start anew."""
    schedules = found.bands.filter(F.col("row") == -1).select(*KEY).distinct()
    pages = elems.select(*KEY).distinct()
    if kind.per_page:
        return rules.on_same_page(pages, schedules.withColumn("schedule_page", F.col("page")), ["doc"], "page")
    return rules.in_force(pages, schedules.withColumn("number", F.col("page")), ["doc"], "page", "number").select(*KEY, "schedule_page")


def _symbols(found: tables.Grid, kind: rules.RuleKind, curves: DataFrame, library: DataFrame) -> DataFrame:
    """(doc, schedule_page, row, group_ord, member, lines, ratio): the shapes that a rule asks for, by groups of which one must match.

    A library's symbols hold for every row; a kind without any takes the curves in the symbol column of the row itself.
    """
    every = tables.extracted(found)
    if kind.schedule in LIBRARY:
        rows = every.filter(F.col("row") >= 0).select(*KEY, "row").distinct().withColumn("schedule", F.lit(kind.schedule))
        return rows.join(F.broadcast(library), "schedule").select("doc", F.col("page").alias("schedule_page"), "row", "group_ord", "member", "lines", "ratio")
    columns = tables.symbol_column(every, found.by)
    drawn = shuffled(found.placed(shuffled(curves).join(found.framed.select(*KEY, "id"), [*KEY, "id"], "left_semi"))).join(columns, [*KEY, "col"])
    return drawn.filter(F.col("row") >= 0).select("doc", F.col("page").alias("schedule_page"), "row", F.lit(0).alias("group_ord"), F.col("id").alias("member"), "lines", "ratio")


def compiled(kind: rules.RuleKind, elems: DataFrame, curves: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the kind's schedules, elements found for them: doc, schedule, page, row, found_page, label and box)."""
    found = tables.grid(elems, kind.key_text, kind.header_above, by=KEY)
    # every later step reads the grid, which would be planned and found anew each time
    found = tables.Grid(found.by, stored(found.bands, "bands"), stored(found.columns, "columns"), stored(found.framed, "framed"))
    rows = stored(schedule_rows(found, kind), "rows")
    asked = shuffled(rows.select("doc", F.col("page").alias("schedule_page"), "row", "row_id")).join(scope(elems, found, kind), ["doc", "schedule_page"]).withColumn("rule_id", F.struct("schedule_page", "row"))
    labels = elems.filter(F.col("text").isNotNull()).select(*KEY, "id", "text", "x0", "y0", "x1", "y1")
    matched = rules.label_matches(labels, asked.select(*KEY, "rule_id", F.trim("row_id").alias("row_id")), KEY, kind.wildcard)
    match = F.concat_ws("|", "doc", "page", "id", "rule_id.schedule_page", "rule_id.row").alias("match")
    matched = stored(shuffled(matched).join(labels.drop("text"), [*KEY, "id"]).withColumn("match", match), "matched")
    around = stored(rules.near_label(matched, curves, REACH, KEY).select(F.col("o_match").alias("match"), *[F.col(f"i_{c}").alias(c) for c in ("id", "lines", "ratio", "x0", "y0", "x1", "y1")]), "around")
    wanted = _symbols(found, kind, curves, library).withColumn("rule_id", F.struct("schedule_page", "row"))
    wanted = wanted.join(shuffled(matched.select("doc", "rule_id", "match")), ["doc", "rule_id"]).select("match", "group_ord", F.concat_ws("|", "match", "group_ord").alias("group"), F.concat_ws("|", "match", "group_ord", "member").alias("member"), "lines", "ratio")
    wanted = stored(wanted, "wanted")
    alike = shapes.most_similar(wanted.select("match", "member", "lines", "ratio"), around.select("match", "id", "lines", "ratio"), "member", "id", NEAR, ["match"])
    alike = stored(alike, "alike")
    whole = shapes.whole_groups(alike.select("member"), wanted.select("group", "member"), "group", "member")
    first = shapes.first_group(shuffled(whole).join(wanted.select("group", "match", "group_ord").distinct(), "group"), ["match"], "group_ord")
    taken = shuffled(wanted).join(first, ["match", "group_ord"]).join(shuffled(alike), "member").select("match", F.col("match_id").alias("id"))
    box = ("x0", "y0", "x1", "y1")
    parts = shuffled(taken).join(around, ["match", "id"]).select("match", *box).unionByName(shuffled(matched).join(first, "match", "left_semi").select("match", *box))
    result = shuffled(rules.highlight(parts, ["match"])).join(matched.drop(*box), "match").select("doc", F.lit(kind.schedule).alias("schedule"), F.col("rule_id.schedule_page").alias("page"), F.col("rule_id.row").alias("row"), F.col("page").alias("found_page"), "id", "label", *box)
    return rows.drop("row_id"), boxes.drop_covered(result, ["doc", "schedule", "page", "row", "found_page"])


def run(elems: DataFrame, curves: DataFrame, library: DataFrame, kinds: Sequence[rules.RuleKind] = rules.RULES) -> tuple[DataFrame, DataFrame]:
    """(rows of all schedules, elements found) of documents; a document without tables has neither."""
    with ThreadPoolExecutor(len(kinds)) as side:  # the kinds' jobs run side by side
        parts = list(side.map(lambda kind: compiled(kind, elems, curves, library), kinds))
    rows, found = parts[0]
    for more_rows, more_found in parts[1:]:
        rows, found = rows.unionByName(more_rows), found.unionByName(more_found)
    return rows, found


# built documents: a door schedule, labels, a window schedule (not in every third document), a lighting page, a later door schedule

#: Symbols of the library by schedule: groups of curves, each a list of lines.
LIBRARY = {
    "doors": [[[(0, 0, 8, 0), (8, 0, 8, 8), (0, 0, 8, 8)]]],
    "windows": [[[(0, 0, 6, 0), (0, 0, 3, 9), (3, 9, 6, 0)], [(0, 0, 2, 2), (0, 2, 2, 0)]], [[(0, 0, 12, 3), (0, 3, 12, 0)]]],
}
LAMP = [(0, 0, 5, 5), (0, 5, 5, 0), (0, 0, 5, 0)]


def _lines(lines: Sequence[tuple[float, ...]]) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(line, ("x0", "y0", "x1", "y1"), strict=True)]) for line in lines])


def symbol_library(spark: SparkSession) -> DataFrame:
    """(schedule, group_ord, member, lines, ratio) of LIBRARY; member is unique within a group."""
    rows = [(name, k, m, [[float(v) for v in line] for line in curve]) for name, groups in LIBRARY.items() for k, group in enumerate(groups) for m, curve in enumerate(group)]
    made = spark.createDataFrame(rows, "schedule string, group_ord int, member bigint, raw array<array<double>>")
    lines = F.transform("raw", lambda v: F.struct(v[0].alias("x0"), v[1].alias("y0"), v[2].alias("x1"), v[3].alias("y1")))
    box = g.lines_box(F.col("lines"))
    return made.withColumn("lines", lines).withColumn("ratio", g.height_to_width(box["x1"] - box["x0"], box["y1"] - box["y0"])).drop("raw")


class _Drawing:
    """Collects the elements and curves of a document built from a key column."""

    def __init__(self) -> None:
        self.items: list[Column] = []

    def add(self, page: int, x0: float, y0: float, x1: float, y1: float, text: Column | str | None = None, is_rect: bool = False, lines: Sequence | None = None, when: Column | bool = True) -> None:
        text = F.lit(text) if text is None or isinstance(text, str) else text
        drawn = _lines(lines) if lines else F.lit(None).cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")
        box = [F.lit(float(v)).alias(c) for v, c in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)]
        item = F.struct(F.lit(page).alias("page"), F.lit(len(self.items)).cast("bigint").alias("id"), *box, text.cast("string").alias("text"), F.lit(is_rect).alias("is_rect"), drawn.alias("lines"))
        self.items.append(item if when is True else F.when(when, item))

    def curve(self, page: int, x: float, y: float, lines: Sequence[tuple[float, ...]], when: Column | bool = True) -> None:
        xs, ys = [v for a in lines for v in (a[0], a[2])], [v for a in lines for v in (a[1], a[3])]
        self.add(page, x + min(xs), y + min(ys), x + max(xs), y + max(ys), lines=lines, when=when)

    def table(self, page: int, title: str, header: Sequence[str], ids: Sequence[Column | str], when: Column | bool = True, symbols: Sequence = ()) -> None:
        """A table of three columns at the origin: 20 units a row below a header, or a header above the rectangle with symbols."""
        high = 20.0 * len(ids)
        top = high + 20
        self.add(page, 10, top + 30, 60, top + 40, title, when=when)
        self.add(page, 0, 0, 90, top, is_rect=True, when=when)
        for y in range(0, int(high) + 1, 20):
            self.add(page, 0, y, 90, y, when=when)
        for x in (30, 60):
            self.add(page, x, 0, x, top + 10 if symbols else top, when=when)
        for k, name in enumerate(header):
            y = top + 8 if symbols else high + 5
            self.add(page, 5 + 30 * k, y, 15 + 30 * k, y + 10, name, when=when)
        for k, name in enumerate(ids):
            y = (top if symbols else high) - 20 * (k + 1) + 5
            self.add(page, 5, y, 15, y + 10, name, when=when)
            self.add(page, 35, y, 45, y + 10, F.concat(F.lit("row "), F.lit(str(k))), when=when)
            if symbols:
                self.curve(page, 65, y, symbols[k], when)


def documents(suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, curves) of one document for each supplier (s_suppkey)."""
    n, d = F.col("s_suppkey"), _Drawing()
    own = F.concat(F.lit("D"), n.cast("string"))
    door, window, dots, wide = LIBRARY["doors"][0][0], *LIBRARY["windows"][0], LIBRARY["windows"][1][0]
    d.table(1, "Door Schedule", ("ID", "Name", "Symbol"), (own, "C", "C+"))
    for x, label, near in ((200, own, True), (300, own, False), (400, "C", True), (500, "CO", True)):
        d.add(2, x, 100, x + 10, 110, label)
        if near:
            d.curve(2, x + 1, 101, door)
    d.add(2, 200, 100, 210, 110, own, when=n % 2 == 0)  # drawn twice: covered by the first
    d.table(3, "Window\nSchedule", ("Mark", "Name", "Symbol"), ("W##", "V"), when=n % 3 != 0)
    for page in (3, 4):
        d.add(page, 200, 300, 212, 310, "W12")
        d.curve(page, 203, 301, window)
        d.curve(page, 214, 305, dots, when=n % 5 != 0)  # without it the first group is not whole
        d.add(page, 400, 300, 412, 310, "V ")
        d.curve(page, 400, 302, wide)
    for page in (5, 6):
        d.add(page, 300, 300, 310, 310, "L")
        d.curve(page, 301, 301, LAMP)
    d.table(5, "LIGHTING LEGEND", ("Key", "Name", "Symbol"), ("L", "M"), symbols=(LAMP, door))
    d.table(7, "door schedule", ("ID", "Name", "Symbol"), ("E", own), when=n % 4 == 0)
    for x, label in ((200, own), (300, "C"), (400, "E")):
        d.add(8, x, 100, x + 10, 110, label)
        d.curve(8, x + 1, 101, door)
    items = suppliers.select(n.alias("doc"), F.explode(F.array_compact(F.array(*d.items))).alias("e")).select("doc", "e.*").withColumn("is_container", F.lit(False))
    box = g.lines_box(F.col("lines"))
    curves = items.filter(F.col("lines").isNotNull()).select(*KEY, "id", "x0", "y0", "x1", "y1", g.zeroed_lines(F.col("lines")).alias("lines"), g.height_to_width(box["x1"] - box["x0"], box["y1"] - box["y0"]).alias("ratio"))
    return items.drop("lines"), curves


def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    elems, curves = documents(dealt(base(spark, sf, "supplier").select("s_suppkey"), "s_suppkey"))
    return run(stored(elems, "elems"), stored(curves, "curves"), symbol_library(spark))


@query(
    """WITH n AS (SELECT s_suppkey AS doc FROM supplier),
    sched AS (SELECT doc, s.* FROM n, (VALUES ('doors', 1, 0, NULL), ('doors', 1, 1, 'C'), ('doors', 1, 2, 'C+'), ('windows', 3, 0, 'W##'), ('windows', 3, 1, 'V'), ('lighting', 5, 0, 'L'), ('lighting', 5, 1, 'M'), ('lighting', 5, 2, ''), ('doors', 7, 0, 'E'), ('doors', 7, 1, NULL)) s(schedule, page, row, row_id)
      WHERE (page <> 3 OR doc % 3 <> 0) AND (page <> 7 OR doc % 4 = 0)),
    drawn AS (SELECT doc, p.* FROM n, (VALUES (2, 'D', 200, 100, 10.0, 10.0), (2, 'C', 400, 100, 10.0, 10.0), (8, 'D', 200, 100, 10.0, 10.0), (8, 'C', 300, 100, 10.0, 10.0), (8, 'E', 400, 100, 10.0, 10.0),
      (3, 'W12', 200, 300, 16.0, 10.0), (4, 'W12', 200, 300, 16.0, 10.0), (3, 'V', 400, 300, 12.0, 10.0), (4, 'V', 400, 300, 12.0, 10.0), (5, 'L', 300, 300, 10.0, 10.0)) p(spot, label, x0, y0, w, h) WHERE label <> 'W12' OR doc % 5 <> 0),
    held AS (SELECT r.*, d.spot AS found_page, CASE d.label WHEN 'D' THEN 'D' || d.doc ELSE d.label END AS label, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM sched r JOIN drawn d ON r.doc = d.doc AND CASE WHEN r.row_id IS NULL THEN d.label = 'D' WHEN r.row_id = 'C+' THEN d.label = 'C' WHEN r.row_id = 'W##' THEN d.label = 'W12' ELSE d.label = r.row_id END
      AND CASE r.schedule WHEN 'lighting' THEN d.spot = r.page WHEN 'windows' THEN d.spot >= r.page ELSE d.spot >= r.page AND (r.page = 7 OR d.spot < 7 OR r.doc % 4 <> 0) END)
    SELECT sched.doc, sched.schedule, sched.page, sched.row, coalesce(sched.row_id, 'D' || sched.doc) AS row_id, found_page, label, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1
    FROM sched LEFT JOIN held USING (doc, schedule, page, row)"""
)
def document_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every schedule row of every document with the elements found for it, if any."""
    rows, found = _run(spark, sf)
    return rows.select("doc", "schedule", "page", "row", F.col("cells")[0]["label"].alias("row_id")).join(shuffled(found.drop("id")), ["doc", "schedule", "page", "row"], "left")


@query(None)
def document_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same as one JSON summary for each document."""
    rows, found = _run(spark, sf)
    bbox = F.array("x0", "y0", "x1", "y1").alias("bbox")
    return summary.schedules_document(rows, found.select("doc", "schedule", "page", "row", "found_page", "label", bbox))
