"""Summaries: progress by key, merging of partial results, the nested document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shuffled

PROGRESS = ("curr_step", "total_steps", "msg", "success")


def latest(events: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """One row for each key: the last value of every column that is not null, in the order of (ts, seq).

    Partial maxima are combined before the shuffle, so a key with very many events costs one row for each task.
    """

    def last(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))["v"].alias(c)

    return events.groupBy(key).agg(*[last(c) for c in columns])


def merged(parts: DataFrame, key: Sequence[str], ordinal: str, strings: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Deep merge of partial results in order: a string is replaced while it is empty, or by a later value; lists are joined."""

    def string(c: str) -> Column:
        return F.max(F.struct(F.coalesce(F.col(c) != "", F.lit(False)).alias("some"), F.col(ordinal).alias("o"), F.col(c).alias("v")))["v"].alias(c)

    def listed(c: str) -> Column:
        items = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(c).alias("v"))))
        return F.flatten(F.transform(items, lambda v: v["v"])).alias(c)

    return parts.groupBy(*key).agg(*[string(c) for c in strings], *[listed(c) for c in lists])


def schedules_document(rows: DataFrame, matches: DataFrame, by: Sequence[str] = ("doc",)) -> DataFrame:
    """(doc, summary): JSON of schedules, their pages and rows with the elements found for each row.

    rows (doc, schedule, page, row, cells); matches (doc, schedule, page, row, label, ...).
    """
    keys = [*by, "schedule", "page", "row"]
    found = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in matches.columns if c not in keys]))).alias("elems"))
    filled = shuffled(rows).join(found, keys, "left")
    pages = filled.groupBy(*by, "schedule", "page").agg(F.array_sort(F.collect_list(F.struct("row", "cells", "elems"))).alias("rows"))
    named = pages.groupBy(*by, "schedule").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page").cast("string"), "rows")))).alias("pages"))
    return named.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("schedule", "pages")), _by_schedule))).alias("summary"))


def _by_schedule(a: Column, b: Column) -> Column:
    return F.when(a["schedule"] < b["schedule"], -1).when(a["schedule"] > b["schedule"], 1).otherwise(0)


def empty_summary() -> Column:
    """The document that a run starts with."""
    nothing = F.create_map().cast("map<string, string>")
    return F.to_json(F.struct(nothing.alias("doors"), nothing.alias("windows"), nothing.alias("lighting"), F.lit("").alias("houseName"), F.lit("").alias("architectName"), nothing.alias("pageNames")))


def page_name(elems: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """(page, name): texts of the title corner, from the top down, without keys and captions."""
    from ..functions.texts import is_page_name

    corner = elems.filter((F.col("x0") >= F.col("page_width") - 251) & (F.col("y1") <= 288) & is_page_name(F.col("text")))
    items = F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("y"), "id", "text")))
    return corner.groupBy(*by).agg(F.array_join(F.transform(items, lambda v: F.trim(v["text"])), " ").alias("name"))


def house_name(elems: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """(page, name): texts below the caption "project name" down to the next title, without the owner's line."""
    from ..functions import texts as t

    key = t.normal_key(F.col("text"))
    caption = elems.filter(key.rlike("^project name.{0,2}")).groupBy(*by).agg(F.max(F.struct("y0", "x0", "x1")).alias("c"))
    under = elems.join(caption, list(by)).filter((F.col("y1") <= F.col("c.y0")) & (F.col("x1") >= F.col("c.x0")) & (F.col("x0") <= F.col("c.x1"))).withColumn("_k", key)
    stop = under.filter(F.col("_k").startswith("drawing title")).groupBy(*by).agg(F.max("y1").alias("_stop"))
    named = under.join(stop, list(by), "left").filter((F.col("y0") >= F.coalesce("_stop", F.lit(float("-inf")))) & ~F.col("_k").startswith("owner") & ~F.col("_k").startswith("drawing title"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("y"), "id", "text", F.col("_stop").isNotNull().alias("stopped"))))
    # without a title below, the first three lines
    short = F.when(F.element_at(items, 1)["stopped"], items).otherwise(F.slice(items, 1, 3))
    return named.groupBy(*by).agg(F.array_join(F.transform(short, lambda v: F.trim(v["text"])), " ").alias("name"))
