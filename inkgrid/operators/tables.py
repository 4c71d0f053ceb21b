"""Tables of a page: header, column and row bands, cells and their texts.

Elements are rows (page, id, x0, y0, x1, y1, text, is_rect, is_container, ...); a table is found by its key text.  All steps are
joins and windows partitioned by page, so pages run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import texts as t
from ..functions.geometry import Box
from .graph import shuffled

#: How far left-aligned lines, header lines and cell edges may lie off.
LEFT, BELOW_TOP, PADDING = 10.0, 5.0, 0.1


def first_by_key(elems: DataFrame, keys: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """The first element of each page whose normalised text is a key: (page, key_text, id, box)."""
    found = elems.withColumn("key_text", t.normal_key(F.col("text"))).join(keys, "key_text")
    first = F.min(F.struct("id", "x0", "y0", "x1", "y1")).alias("m")
    return found.groupBy(*by, "key_text").agg(first).select(*by, "key_text", "m.*")


def groups_by_key(elems: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """Elements by normalised text: number and smallest id."""
    return elems.groupBy(*by, t.normal_key(F.col("text")).alias("key_text")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def row_bands(lines: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """(page, band, top, bottom): consecutive pairs of horizontal lines from the top down.

    A repeated height makes no band.
    """
    levels = lines.groupBy(*by, "y1").agg(F.min("id").alias("id"))
    order = Window.partitionBy(*by).orderBy(F.col("y1").desc())
    paired = levels.withColumns({"top": F.lag("y1").over(order), "band": (F.row_number().over(order) - 2).cast("int")})
    return paired.filter(F.col("top").isNotNull()).select(*by, "band", "top", F.col("y1").alias("bottom"))


def column_bands(dividers: DataFrame, tables: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """(page, col, left, right): between consecutive dividers, the table's own sides first and last."""
    edges = dividers.select(*by, F.col("x0").alias("x")).unionByName(tables.select(*by, F.col("x0").alias("x"))).unionByName(tables.select(*by, F.col("x1").alias("x"))).distinct()
    order = Window.partitionBy(*by).orderBy("x")
    return edges.withColumns({"left": F.lag("x").over(order), "col": (F.row_number().over(order) - 2).cast("int")}).filter(F.col("left").isNotNull()).select(*by, "col", "left", F.col("x").alias("right"))


def assigned(elems: DataFrame, bands: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """Elements with the column whose [left, right) holds their right end; others are left out.

    Columns do not overlap, so an element's is the last one that begins at or before its end: one window over columns and elements, no
    pairs of them.
    """
    by, rest = list(by), [c for c in bands.columns if c not in by]
    both = elems.select(*by, F.col("x1").alias("_x"), F.lit(1).alias("_k"), F.struct("*").alias("_e")).unionByName(bands.select(*by, F.col("left").alias("_x"), F.lit(0).alias("_k"), F.struct(*rest).alias("_b")), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_b", ignorenulls=True).over(order)).filter((F.col("_k") == 1) & (F.col("_x") < F.col("_last.right")))
    return found.select("_e.*", *[F.col(f"_last.{c}").alias(c) for c in rest])


def text_lines(elems: DataFrame, by: Sequence[str]) -> DataFrame:
    """Elements with `line`: groups of rows that overlap in y, from the top down (gaps and islands)."""
    order = Window.partitionBy(*by).orderBy(F.col("y1").desc(), "x0", "id")
    lowest = F.min("y0").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return elems.withColumn("_new", F.when(lowest.isNull() | (F.col("y1") < lowest), 1).otherwise(0)).withColumn("line", F.sum("_new").over(order)).drop("_new")


def cell_texts(elems: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, text): texts of a cell, lines from the top down joined by spaces, each from left to right."""
    lined = text_lines(elems, by).withColumn("shown", F.col("text"))
    runs = lined.groupBy(*by, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "id", F.col("shown").alias("text")))).alias("items"))
    runs = runs.withColumn("text", t.joined_cells(F.col("items")))
    rows = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return rows.select(*by, F.concat_ws(" ", F.transform("lines", lambda v: v["text"])).alias("text"))


@dataclass(frozen=True)
class Grid:
    """The tables of all pages: bands (by, row, top, bottom), columns (by, col, left, right), and the elements inside (framed)."""

    by: list[str]
    bands: DataFrame
    columns: DataFrame
    framed: DataFrame

    def placed(self, elems: DataFrame) -> DataFrame:
        """Elements with their row and column; those that cross an edge are left out."""
        inside = shuffled(elems).join(self.bands, self.by).filter((F.col("y0") >= F.col("bottom") + PADDING) & (F.col("y1") <= F.col("top") - PADDING))
        return assigned(inside, self.columns, self.by)


def grid(elems: DataFrame, key_text: str, header_above: bool = False, has_header: bool = True, by: Sequence[str] = ("page",)) -> Grid:
    """Rows and columns of the table of each page that has the key text; row -1 is the header.

    A page without a rectangle below its key, or without a line under the header, has no table.
    """
    by = list(by)
    key = first_by_key(elems, F.broadcast(elems.sparkSession.createDataFrame([(key_text,)], "key_text string")), by).select(*by, *[F.col(c).alias(f"k{c}") for c in ("x0", "y0", "x1", "y1")])
    high = F.col("ky1") - F.col("ky0")
    corner = F.col("x0").between(F.col("kx0") - 2 * high, F.col("kx1")) & F.col("y1").between(F.col("ky0") - 4 * high, F.col("ky0"))
    rects = shuffled(elems.filter(F.col("is_rect"))).join(key, by).filter(corner)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = rects.groupBy(*by).agg(F.max(F.struct(area.alias("a"), (-F.col("id")).alias("i"), "x0", "y0", "x1", "y1", "ky0")).alias("m"))
    table = best.select(*by, F.col("m.x0").alias("tx0"), F.col("m.y0").alias("ty0"), F.col("m.x1").alias("tx1"), (F.col("m.ky0") if header_above else F.col("m.y1")).alias("ty1"), F.col("m.y1").alias("rect_top"), F.col("m.ky0").alias("ky0"))
    box, area_box = Box.of(), Box.of("t")
    inside = shuffled(elems).join(table, by).filter(p.contains(area_box, box))
    left = inside.filter((F.col("x0") <= F.col("tx0") + LEFT) & p.is_horizontal(box))
    if header_above:
        header = table.select(*by, F.col("rect_top").alias("hy0"), F.col("ky0").alias("hy1"))
    elif has_header:
        header = left.filter(F.col("y1") < F.col("ty1") - BELOW_TOP).groupBy(*by).agg(F.max("y1").alias("hy0"), F.first("ty1").alias("hy1"))
    else:
        header = table.select(*by, F.col("ty1").alias("hy0"), F.col("ty1").alias("hy1"))
    framed = shuffled(inside).join(header, by)
    dividers = framed.filter((F.col("y0") >= F.col("ty0")) & (F.col("y1") >= F.col("hy0")) & p.is_vertical(box) & (F.col("x0") > F.col("tx0") + PADDING) & (F.col("x1") < F.col("tx1") - PADDING))
    columns = column_bands(dividers.select(*by, "x0"), shuffled(table).join(header, by).select(*by, F.col("tx0").alias("x0"), F.col("tx1").alias("x1")), by)
    floor = dividers.groupBy(*by).agg(F.max("y0").alias("floor"))
    lines = shuffled(left).join(header, by).filter(F.col("y1") <= F.col("hy0")).select(*by, "id", "y1").unionByName(header.select(*by, F.lit(-1).cast("bigint").alias("id"), F.col("hy0").alias("y1")))
    lines = lines.unionByName(table.select(*by, F.lit(-2).cast("bigint").alias("id"), F.col("ty0").alias("y1")))
    rows = shuffled(row_bands(lines, by)).join(floor, by, "left").filter((F.col("top") > F.coalesce("floor", F.lit(float("-inf")))) & (F.col("top") - F.col("bottom") > 2 * PADDING)).drop("floor")
    bands = rows.select(*by, F.col("band").alias("row"), "top", "bottom").unionByName(header.select(*by, F.lit(-1).alias("row"), F.col("hy1").alias("top"), F.col("hy0").alias("bottom")))
    return Grid(by, bands, columns, framed)


def extract(elems: DataFrame, key_text: str, header_above: bool = False, has_header: bool = True, by: Sequence[str] = ("page",)) -> DataFrame:
    """(page, row, col, text): cells of the table of each page that has the key text; row -1 is the header."""
    return extracted(grid(elems, key_text, header_above, has_header, by))


def extracted(found: Grid) -> DataFrame:
    """(by, row, col, text) of every cell of the tables, empty ones too."""
    by = found.by
    drawn = found.framed.filter(F.col("text").isNotNull() & ~F.col("is_container"))
    cells = cell_texts(found.placed(drawn), [*by, "row", "col"])
    every = shuffled(found.bands.select(*by, "row")).join(found.columns.select(*by, "col"), by)
    return shuffled(every).join(cells, [*by, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def with_headers(cells: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """Body cells with the text of their column's header as `key`."""
    header = cells.filter(F.col("row") == -1).select(*by, "col", F.col("text").alias("key"))
    return shuffled(cells.filter(F.col("row") >= 0)).join(header, [*by, "col"])


def symbol_column(cells: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """(page, col): the last column whose header mentions a symbol, else the first."""
    named = F.max(F.when((F.col("row") == -1) & (F.instr(F.lower("text"), "symbol") > 0), F.col("col")))
    return cells.groupBy(*by).agg(F.coalesce(named, F.lit(0)).alias("col"))
