"""Layers of a page: what the elements of one layer form becomes the nodes of the next, with links from parents to children.

Layer 0 holds lines and glyphs.  Layer 1 holds the circles and hexagons that lines close, the shapes that lines vote for and the words
that glyphs form.  Layer 2 holds the fractions of words and bars and the labels: outlines with the words inside.  Layer 3 holds the
phrases of fractions and the texts level with them.  Every stage is written once and read by the next, so nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shapes, spatial, words
from .cycles import outlines
from .graph import stored

NODE = ["layer", "kind", "node", "name", "x0", "y0", "x1", "y1"]


def _named(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def _row(df: DataFrame, on: Sequence[str], layer: int, kind: Column | str, node: Column, name: Column, children: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(*on, F.lit(layer).alias("layer"), kind.alias("kind"), node.alias("node"), name.cast("string").alias("name"), "x0", "y0", "x1", "y1", children.alias("children"))


def _strings(kind: str, ids: Column) -> Column:
    return F.transform(ids, lambda i: _named(kind, i))


def outline_parents(lines: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """Circles and hexagons, over the lines that close them."""
    found = outlines(lines, on)
    return _row(found, on, 1, F.col("kind"), F.concat("kind", F.lit(":"), F.array_min("ids").cast("string")), F.lit(None), _strings("line", F.col("ids")))


def shape_parents(lines: DataFrame, templates: DataFrame, shape: str, on: Sequence[str] = ("page",), least: float = shapes.SHAPE) -> DataFrame:
    """Shapes that the lines of a page vote for, over the lines that voted; votes come together in blocks and are not shuffled."""
    found = shapes.scored(lines, templates, shape, on, least, voters=True)
    node = F.concat(F.lit("shape:"), F.concat_ws(":", *[F.col(c).cast("string") for c in (shape, "cell_x", "cell_y")]))
    return _row(found, on, 1, "shape", node, F.col(shape), _strings("line", F.col("ids")))


def word_parents(made: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    return _row(made, on, 1, "word", _named("word", F.col("id")), F.col("text"), _strings("glyph", F.array_sort("children")))


def fraction_parents(made: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    children = F.array_sort(F.concat(_strings("word", F.array("top", "low")), F.array(_named("line", F.col("bar")))))
    return _row(made, on, 2, "fraction", _named("fraction", F.col("id")), F.col("text"), children)


def label_parents(frames: DataFrame, made_words: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """Circles and hexagons with words inside, read from left to right; over the outline and its words."""
    outer = frames.select(*on, F.col("node").alias("id"), "x0", "y0", "x1", "y1")
    inner = made_words.select(*on, "id", "text", "x0", "y0", "x1", "y1")
    items = F.array_sort(F.collect_list(F.struct(F.col("i_x0").alias("x"), F.col("i_id").alias("id"), F.col("i_text").alias("text"))))
    found = spatial.containment(outer, inner, on).groupBy(*on, "o_id", *[F.col(f"o_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]).agg(items.alias("items"))
    children = F.array_sort(F.concat(F.array("o_id"), F.transform("items", lambda v: _named("word", v["id"]))))
    return _row(found, on, 2, "label", F.concat(F.lit("label:"), "o_id"), F.array_join(F.transform("items", lambda v: v["text"]), ""), children)


def phrase_parents(layer2: DataFrame, made: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """Phrases: groups of two and more of the fractions and the words level with them."""
    phrases = words.clustered(layer2, words.fraction_links(layer2, on), on).filter(F.size("children") > 1)
    is_fraction = made.select(*on, F.col("id").alias("child"), F.lit(True).alias("is_fraction"))
    each = phrases.select(*on, "id", F.explode("children").alias("child")).join(is_fraction, [*on, "child"], "left")
    named = each.groupBy(*on, "id").agg(F.array_sort(F.collect_list(F.concat(F.when(F.col("is_fraction"), F.lit("fraction:")).otherwise(F.lit("word:")), F.col("child").cast("string")))).alias("named"))
    return _row(phrases.join(named, [*on, "id"]), on, 3, "phrase", _named("phrase", F.col("id")), F.col("text"), F.col("named"))


def activate(lines: DataFrame, glyphs: DataFrame, bars: DataFrame, templates: DataFrame, shape: str, on: Sequence[str] = ("page",), least: float = shapes.SHAPE) -> DataFrame:
    """(page, layer, kind, node, name, box, children) of all layers above the elements; children are names of nodes below.

    lines (page, id, x0, y0, x1, y1), glyphs (page, id, box, text, left_right, fontsize), bars as in `words.fractions`, templates as
    in `shapes.template_lines`.  Ids are distinct over pages.
    """
    with ThreadPoolExecutor(2) as side:  # outlines do not wait for words
        outlines_made = side.submit(lambda: stored(outline_parents(lines, on), "outlines"))
        made_words = stored(words.words(glyphs, on, allow_space=True), "words")
        frames = outlines_made.result()
    matched = words.fractions(made_words.select(*on, *words.NODE), bars, on)
    made = stored(words.fraction_nodes(made_words, bars, matched, on), "fractions")
    used = made.select(*on, F.explode(F.array("top", "low")).alias("id"))
    layer2 = stored(made_words.select(*on, *words.NODE).join(used, [*on, "id"], "left_anti").unionByName(made.select(*on, *words.NODE)), "layer2")
    parts = [frames, shape_parents(lines, templates, shape, on, least), word_parents(made_words, on), fraction_parents(made, on), label_parents(frames, made_words, on), phrase_parents(layer2, made, on)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def edges(nodes: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, layer, parent, child) of the links between layers."""
    return nodes.select(*on, "layer", F.col("node").alias("parent"), F.explode("children").alias("child"))


def orphans(nodes: DataFrame, layer: int, on: Sequence[str] = ("page",)) -> DataFrame:
    """Nodes of a layer that no node above holds."""
    held = edges(nodes.filter(F.col("layer") > layer), on).select(*on, F.col("child").alias("node"))
    return nodes.filter(F.col("layer") == layer).join(held, [*on, "node"], "left_anti")
