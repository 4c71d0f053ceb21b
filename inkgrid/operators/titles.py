"""Titles of drawings: names of pages from their title corner, names of houses from the texts below a caption.

Elements are (keys, id, x0, y0, x1, y1, text, parent, page_width, page_height) with y up; only containers without a parent are read,
and the keys `by` name a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of the corner that holds a page's name, captions that are no name, how a page's key looks.
CORNER_WIDTH, CORNER_HEIGHT = 251.0, 288.0
CAPTIONS = ("drawing title", "drawing number")
PAGE_KEY = "[a-zA-Z]-[0-9][0-9]?"
#: The caption above a house's name, the text that ends it, lines to skip, lines to take where nothing ends it.
CAPTION, STOP, SKIP, LINES = "project name", "drawing title", "owner", 3


def _flat(text: Column, by: str = "") -> Column:
    return F.replace(text, F.lit("\n"), F.lit(by))


def _listed(text: Column) -> Column:
    """Texts from the top down, ties by id."""
    return F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("y"), "id", text.alias("text"))))


def page_names(elems: DataFrame, by: Sequence[str] = ("doc", "page")) -> DataFrame:
    """(page, name): the texts of the title corner from the top down, without captions and keys; "" for a page without any."""
    key = _flat(F.lower("text"))
    inside = (F.col("x0") >= F.col("page_width") - CORNER_WIDTH) & (F.col("x1") <= F.col("page_width")) & (F.col("y0") >= 0) & (F.col("y1") <= CORNER_HEIGHT)
    named = inside & F.col("parent").isNull() & F.col("text").isNotNull() & ~key.rlike(PAGE_KEY) & ~key.isin(*CAPTIONS)
    items = _listed(F.when(F.coalesce(named, F.lit(False)), F.col("text")))
    texts = F.array_compact(F.transform(items, lambda v: v["text"]))
    return elems.groupBy(*by).agg(_flat(F.trim(F.array_join(texts, " ")), " ").alias("name"))


def house_names(elems: DataFrame, by: Sequence[str] = ("doc", "page")) -> DataFrame:
    """(page, anchor, name): for each caption in the lower right, the texts below it down to the next title.

    The texts of a page below its captions are read in one window from the top down; where no title follows, the first
    three lines count, those that are skipped included.
    """
    by = list(by)
    free = elems.filter(F.col("parent").isNull())
    low = F.lower(F.coalesce("text", F.lit("")))
    caption = low.startswith(CAPTION) & (F.col("x0") / F.col("page_width") >= 0.8) & (F.col("y0") / F.col("page_height") <= 0.4)
    anchors = elems.filter(caption).select(*by, F.col("id").alias("anchor"), F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.col("page_width").alias("_w"))
    below = (F.col("x0") >= F.col("_x0") - 10) & (F.col("x1") <= F.col("_w")) & (F.col("y0") >= 0) & (F.col("y1") <= F.col("_y0"))
    found = anchors.join(free.select(*by, "id", "x0", "y0", "x1", "y1", "text"), by).filter(below)
    group = Window.partitionBy(*by, "anchor")
    down = group.orderBy(F.col("y0").desc(), "id")
    title = F.instr(low, STOP) > 0
    read = found.withColumns({"_title": title, "_nth": F.row_number().over(down)}).withColumns({"_ended": F.max("_title").over(down), "_any": F.max("_title").over(group)})
    kept = read.filter(~F.col("_ended") & (F.col("_any") | (F.col("_nth") <= LINES)) & F.col("text").isNotNull() & ~low.startswith(SKIP))
    texts = kept.groupBy(*by, "anchor").agg(_listed(_flat(F.col("text"), " ")).alias("items"))
    named = texts.select(*by, "anchor", F.trim(F.array_join(F.transform("items", lambda v: v["text"]), "")).alias("name"))
    return anchors.select(*by, "anchor").join(named, [*by, "anchor"], "left").select(*by, "anchor", F.coalesce("name", F.lit("")).alias("name"))


def document_titles(elems: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """(doc, page, page_name, house_name) of all pages of all documents; the house's name is that of the last page that has one."""
    houses = house_names(elems, [doc, page]).groupBy(doc).agg(F.max_by("name", F.struct(page, "anchor")).alias("house_name"))
    return page_names(elems, [doc, page]).withColumnRenamed("name", "page_name").join(houses, doc, "left")
