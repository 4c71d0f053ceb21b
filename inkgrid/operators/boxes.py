"""Aggregations and ordering of boxes: bounding boxes, largest groups, duplicates, hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import Box
from .graph import shuffled


def bounding(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> list[Column]:
    """Aggregates of a bounding box; (0, 0, 1, 1) where there are no boxes."""
    return [F.coalesce(F.min(x0), F.lit(0.0)).alias("x0"), F.coalesce(F.min(y0), F.lit(0.0)).alias("y0"), F.coalesce(F.max(x1), F.lit(1.0)).alias("x1"), F.coalesce(F.max(y1), F.lit(1.0)).alias("y1")]


def bounding_box(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(*bounding())


def largest_group(boxes: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Of each `by`: the bounding box of the group with the largest perimeter, ties to the smaller group."""
    groups = bounding_box(boxes, [*by, group]).withColumn("perimeter", g.perimeter(Box.of()))
    # the maximum of (perimeter, group descending): keep the perimeter first, then the smallest group that has it
    best = groups.groupBy(*by).agg(F.max("perimeter").alias("perimeter"))
    tied = groups.join(best, [*by, "perimeter"])
    return tied.groupBy(*by).agg(F.min(F.struct(group, "x0", "y0", "x1", "y1", "perimeter")).alias("m")).select(*by, "m.*")


def largest_box(boxes: DataFrame, by: Sequence[str], id_col: str = "id") -> DataFrame:
    """Of each `by`: the box of largest area, ties to the smaller id."""
    area = Box.of().width * Box.of().height
    return boxes.groupBy(*by).agg(F.max(F.struct(area.alias("area"), (-F.col(id_col)).alias("_i"), F.struct("*").alias("row"))).alias("m")).select("m.row.*")


def drop_covered(boxes: DataFrame, by: Sequence[str], id_col: str = "id", share: float = 0.9) -> DataFrame:
    """Keeps the largest box of each group and every box that it covers by no more than `share` of the box's own area.

    As the engine to match has it, boxes are compared with the largest one only.
    """
    area = (Box.of().width * Box.of().height).alias("area")
    top = boxes.groupBy(*by).agg(F.max(F.struct(area, (-F.col(id_col)).alias("i"), "x0", "y0", "x1", "y1")).alias("_t"))
    largest = Box(F.col("_t.x0"), F.col("_t.y0"), F.col("_t.x1"), F.col("_t.y1"))
    own = Box.of().width * Box.of().height
    keep = (F.col(id_col) == -F.col("_t.i")) | (g.overlap_area(largest, Box.of()) <= share * own)
    return shuffled(boxes).join(top, list(by)).filter(keep).drop("_t")


def suppress(boxes: DataFrame, by: Sequence[str], id_col: str = "id", share: float = 0.9, touching: bool = False) -> DataFrame:
    """Greedy suppression inside each group: by area descending, a box goes if a kept one covers more than `share` of it.

    With touching, any overlap with a kept box is enough.  Groups are single pages, whose elements fit in a task.
    """

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_a=(rows.x1 - rows.x0) * (rows.y1 - rows.y0)).sort_values(["_a", id_col], ascending=[False, True], kind="stable")
        kept: list[int] = []
        values = rows[["x0", "y0", "x1", "y1", "_a"]].to_numpy()
        every = np.empty_like(values)  # the kept boxes, in its first rows
        for k, (x0, y0, x1, y1, area) in enumerate(values):
            held = every[: len(kept)]
            w, h = np.minimum(held[:, 2], x1) - np.maximum(held[:, 0], x0), np.minimum(held[:, 3], y1) - np.maximum(held[:, 1], y0)
            if touching:
                covered = ((w >= 0) & (h >= 0)).any()
            else:
                covered = ((w > 0) & (h > 0) & (w * h > share * area)).any()
            if not covered:
                every[len(kept)] = values[k]
                kept.append(k)
        return rows.iloc[kept].drop(columns="_a")

    return boxes.groupBy(*by).applyInPandas(greedy, boxes.schema)


def reindex(elems: DataFrame, keep: Column, by: Sequence[str], idx: str = "elem_idx", parent: str = "parent_idx") -> DataFrame:
    """Kept elements with consecutive indices; a parent that is gone, or comes later, becomes null."""
    order = Window.partitionBy(*by).orderBy(idx)
    kept = elems.filter(keep).withColumn("new_idx", (F.row_number().over(order) - 1).cast("int"))
    child, parents = kept.alias("child"), kept.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(idx).alias("_p"), F.col("new_idx").alias("new_parent_idx"))
    same = F.col("_p") == F.col(f"child.{parent}")
    for c in by:
        same = same & (F.col(f"_{c}") == F.col(f"child.{c}"))
    return child.join(parents, same & (F.col("_p") < F.col(f"child.{idx}")), "left").select("child.*", "new_parent_idx")


def promote_orphans(nodes: DataFrame, edges: DataFrame, layer: int) -> DataFrame:
    """Layer memberships of `layer`: nodes of the layer below that have no parent, and the layer's own."""
    below = nodes.filter(F.col("layer_id") == layer - 1).join(edges.select(F.col("child_id").alias("node_id")), "node_id", "left_anti").withColumn("layer_id", F.lit(layer))
    return nodes.filter(F.col("layer_id") == layer).unionByName(below.select(nodes.columns)).distinct()


def duplicates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once, with how often."""
    return rows.groupBy(*columns).agg(F.count("*").alias("times")).filter(F.col("times") > 1)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; repeated rows count."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
