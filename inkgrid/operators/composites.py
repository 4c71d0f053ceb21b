"""End-to-end questions about a page, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as t
from ..functions.geometry import Box
from . import shapes, spatial
from .graph import components


def reading_order(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> list[Column]:
    """Left to right, then from the top down: x0 up, y1 down, x1 up, y0 down."""
    return [F.col(x0).asc(), F.col(y1).desc(), F.col(x1).asc(), F.col(y0).desc()]


def by_distance(nodes: DataFrame, source: DataFrame, k: int, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, source_id, id, distance, nth): the k other nodes of a page that are nearest to each source, nearest first."""
    return spatial.nearest(source, nodes, k, on)


def joined_inside(frames: DataFrame, texts: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, id, text, n): the texts inside each frame, read from left to right and joined."""
    found = spatial.containment(frames, texts, on)
    items = F.array_sort(F.collect_list(F.struct(F.col("i_x0").alias("x0"), F.col("i_id").alias("id"), F.col("i_text").alias("text"))))
    text = F.array_join(F.transform(items, lambda v: v["text"]), "")
    return found.groupBy(*on, F.col("o_id").alias("id")).agg(text.alias("text"), F.count("*").alias("n"))


def keyed_symbols(boxes: DataFrame, texts: DataFrame, template: tuple[float, float], radius: float = 1.0, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, id, text): boxes as large as a template whose inner texts join to a window key."""
    w, h = F.col("x1") - F.col("x0") - template[0], F.col("y1") - F.col("y0") - template[1]
    alike = boxes.filter(w * w + h * h <= radius * radius)
    return joined_inside(alike, texts, on).filter(t.is_window_key(F.col("text"))).select(*on, "id", "text")


def text_runs(nodes: DataFrame, gap: float = 10.0, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, run, n, x0, x1): nodes of a page from left to right, until one begins more than `gap` after all before it."""
    order = Window.partitionBy(*on).orderBy("x0", "id")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = nodes.withColumn("_new", F.when(reach.isNull() | (F.col("x0") - reach > gap), 1).otherwise(0)).withColumn("run", F.sum("_new").over(order))
    return runs.groupBy(*on, "run").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def aligned_groups(nodes: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, component, n): nodes on one line: whole units of y0 and y1 that are equal or next to each other are one group.

    Groups are named by their smallest level, page * 2**40 + (y0 + 2**19) * 2**20 + (y1 + 2**19) in whole units.
    """
    level = lambda a, b: F.col("page") * (1 << 40) + (F.floor(a) + (1 << 19)) * (1 << 20) + (F.floor(b) + (1 << 19))
    rows = nodes.withColumn("level", level(F.col("y0"), F.col("y1")))
    levels = rows.select("level").distinct()
    steps = F.array(*[F.lit(v) for v in (0, 1, 1 << 20, (1 << 20) + 1, (1 << 20) - 1)])
    links = levels.select(F.col("level").alias("a"), F.explode(F.transform(steps, lambda s: F.col("level") + s)).alias("b")).join(levels.select(F.col("level").alias("b")), "b", "left_semi")
    return rows.join(components(links.select("a", "b")), F.col("level") == F.col("node")).groupBy(*on, "component").agg(F.count("*").alias("n"))


def measured_rooms(labels: DataFrame, segments: DataFrame, texts: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, id, text, labels): texts inside the tightest lines around each label, joined, with their number labels."""
    bounds = spatial.enclosing(labels, segments, on).filter(F.col("left").isNotNull() & F.col("bottom").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull())
    rooms = bounds.select(*on, "id", F.col("left").alias("x0"), F.col("bottom").alias("y0"), F.col("right").alias("x1"), F.col("top").alias("y1"))
    return joined_inside(rooms, texts, on).withColumn("labels", t.label_map(F.col("text")))


def room_areas(labels: DataFrame, segments: DataFrame, texts: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, id, text, area): the measures inside the tightest lines around each label, and the product of the first two in square feet.

    A label without lines on all four sides has no row, a room of fewer than two measures no area.
    """
    sizes = t.measures(F.col("text"))
    return measured_rooms(labels, segments, texts, on).withColumn("area", F.get(sizes, F.lit(0)) * F.get(sizes, F.lit(1))).select(*on, "id", "text", "area")


def shape_counts(segments: DataFrame, templates: DataFrame, shape: str, on: Sequence[str] = ("page",), least: float = shapes.SHAPE) -> DataFrame:
    """(shape, n): how often each template is found."""
    return shapes.found_shapes(shapes.votes(segments, templates, shape, on), shape, on, least).groupBy(shape).agg(F.count("*").alias("n"))


def projected(elems: DataFrame, ids: DataFrame, on: Sequence[str] = ("page", "id")) -> DataFrame:
    """Elements of a list of ids."""
    return elems.join(ids, list(on), "left_semi")
