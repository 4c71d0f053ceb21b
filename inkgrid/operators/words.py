"""Words, fractions and phrases from positioned glyphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import predicates as p
from ..functions import texts as t
from ..functions.geometry import Box
from .graph import components, contracted, shuffled, stored
from .spatial import intersection

BOX = ["x0", "y0", "x1", "y1"]
NODE = ["id", "x0", "y0", "x1", "y1", "text", "left_right", "fontsize"]


def runs(glyphs: DataFrame, by: Sequence[str], order: str, touching: float = 1.0) -> DataFrame:
    """(by, word, n, text, box): words of glyphs on one line, in order: a space or a gap ends a word (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    gap = F.abs(F.col("x0") - F.lag("x1").over(w)) >= touching
    new = (F.col("text") == " ") | (F.lag("text").over(w) == " ") | F.lag("x1").over(w).isNull() | gap
    marked = glyphs.withColumn("_new", new.cast("int")).withColumn("word", F.sum("_new").over(w)).filter(F.col("text") != " ")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda v: v["text"]), "")
    return marked.groupBy(*by, "word").agg(F.count("*").alias("n"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: Bytes of texts whose glyphs are laid out at once, besides those of a longer text.
PIECE = 1 << 22


def _laid_out(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(number of the text, first glyph from 1, glyphs, word) of the words of UTF-8 texts that begin at some bytes."""
    ink, fresh = data != 0x20, np.zeros(len(data), bool)
    fresh[begins[begins < len(data)]] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | fresh[1:]
    last[:-1] &= ~ink[1:] | fresh[1:]
    first, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    glyph = np.cumsum((data & 0xC0) != 0x80)
    of = np.searchsorted(begins, first, side="right") - 1
    at = np.r_[0, np.cumsum(end - first)]
    words_ = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(data[ink])).cast(pa.string())
    return of, glyph[first] - glyph[begins[of]] + 1, glyph[end - 1] - glyph[first] + 1, words_


def runs_of_texts(texts: DataFrame, by: Sequence[str], text: str = "text", width: float = 6.0, height: float = 10.0) -> DataFrame:
    """(by, n, text, box): the words of `runs`, for texts of one line whose glyphs lie `width` wide side by side, the first one at `width`.

    The glyphs of a text are in its row, so they are laid out in Arrow batches and only words leave them: no glyph is shuffled or sorted.
    """
    by = list(by)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.fill_null(batch.column(len(by)), "").cast(pa.large_string())
            off = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
            low = 0
            while low < len(own):
                high = max(low + 1, int(np.searchsorted(off, off[low] + PIECE, side="right")) - 1)
                size = int(off[high] - off[low])
                if size:
                    of, first, n, word = _laid_out(np.frombuffer(own.buffers()[2], np.uint8, size, int(off[low])), off[low:high] - off[low])
                    keys = [batch.column(k).slice(low, high - low).take(pa.array(of)) for k in range(len(by))]
                    sides = [first * width, np.zeros(len(n)), (first + n) * width, np.full(len(n), height)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(n), word, *map(pa.array, sides)], [*by, "n", "text", *BOX])
                low = high

    types = dict(texts.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", n long, text string, x0 double, y0 double, x1 double, y1 double"
    return texts.select(*by, text).mapInArrow(search, schema)


def _pairs(nodes: DataFrame, on: Sequence[str], condition: Column) -> DataFrame:
    """Pairs of nodes whose boxes, widened along the reading direction by their own size, meet and fulfil a condition."""
    lr = F.col("left_right")
    wx, wy = F.when(lr, F.col("x1") - F.col("x0")).otherwise(0.0), F.when(lr, F.lit(0.0)).otherwise(F.col("y1") - F.col("y0"))
    rest = [c for c in nodes.columns if c not in ("x0", "y0", "x1", "y1")]
    wide = nodes.select(*rest, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], (F.col("x0") - wx).alias("x0"), (F.col("y0") - wy).alias("y0"), (F.col("x1") + wx).alias("x1"), (F.col("y1") + wy).alias("y1"))
    return intersection(wide, nodes, on, extra=(F.col("a_id") != F.col("b_id")) & condition)


def word_links(nodes: DataFrame, on: Sequence[str] = ("page",), allow_space: bool = False) -> DataFrame:
    """(a, b): nodes that continue each other's word."""
    joins = p.joins_word(Box.of("a__"), Box.of("b_"), F.col("a_left_right"), F.col("a_fontsize"), F.col("b_fontsize"), F.col("b_text"), F.col("b_left_right"), allow_space=allow_space)
    return _pairs(nodes.select(*on, *NODE), on, joins & (F.lit(allow_space) | (F.col("a_text") != " "))).select(*on, F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def fraction_links(nodes: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(a, b): nodes of which one is a fraction and which lie level with each other."""
    either = t.has_fraction(F.col("a_text")) | t.has_fraction(F.col("b_text"))
    joins = p.joins_fraction(Box.of("a__"), Box.of("b_"), F.col("a_left_right"), F.col("b_left_right"), either)
    return _pairs(nodes.select(*on, *NODE), on, joins).select(*on, F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def clustered(nodes: DataFrame, links: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, id, text, box, left_right, fontsize, children): one node for each connected group, named by its smallest id.

    Links count both ways; ids must be distinct over all pages.  Children are read by x0, or by y0 downwards for turned text.
    """
    named = components(links.select("a", "b"))
    grouped = nodes.join(shuffled(named), nodes["id"] == named["node"], "left").withColumn("group", F.coalesce("component", "id"))
    key = F.when(F.col("left_right"), F.col("x0")).otherwise(-F.col("y1"))
    items = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("id").alias("i"), "text")))
    out = grouped.groupBy(*on, "group").agg(items.alias("items"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("left_right").alias("left_right"))
    text = F.array_join(F.transform("items", lambda v: F.coalesce(v["text"], F.lit(""))), "")
    size = F.when(F.col("left_right"), F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0"))
    return out.select(*on, F.col("group").alias("id"), text.alias("text"), "x0", "y0", "x1", "y1", "left_right", size.alias("fontsize"), F.transform("items", lambda v: v["i"]).alias("children"))


def words(nodes: DataFrame, on: Sequence[str] = ("page",), allow_space: bool = False, links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Words of glyphs; another relation of links may be given."""
    own = links(nodes) if links else word_links(nodes, on, allow_space)
    return clustered(nodes, own, on)


def fraction_candidates(nodes: DataFrame, bars: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, node, bar, other, distance, order): numbers with a bar and a number beyond it, in the same direction.

    bars are short lines (page, id, x0, y0, x1, y1, length) or slashes; numbers are texts of digits.
    """
    ints = nodes.filter(t.has_int(F.col("text"))).select(*on, *NODE)
    radius = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    square = Box.of().grown(radius)
    around = ints.select(*on, "id", "text", "left_right", "fontsize", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], square.x0.alias("x0"), square.y0.alias("y0"), square.x1.alias("x1"), square.y1.alias("y1"))
    me, bar, other = Box.of("a__"), Box.of("b_"), Box.of("o_")
    to_bars = intersection(around, bars.select(*on, "id", "x0", "y0", "x1", "y1", "length"), on)
    same = (F.col("a_id") != F.col("b_id")) & (F.col("a_left_right") == F.col("b_left_right")) & (F.abs(F.col("a_fontsize") - F.col("b_fontsize")) < 1)
    to_ints = intersection(around, ints, on, extra=same).select(*on, "a_id", *[F.col(f"b_{c}").alias(f"o_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    trio = shuffled(to_bars).join(to_ints, [*on, "a_id"])
    mid = lambda b: g.midpoint(b)
    (mx, my), (bx, by), (ox, oy) = mid(me), mid(bar), mid(other)
    toward, beyond = g.direction(bx - mx, by - my), g.direction(ox - mx, oy - my)
    fits = p.divider_like(F.col("b_length"), me.width, me.height) | p.divider_like(F.col("b_length"), other.width, other.height)
    between = g.midpoint_distance(other, bar) < g.midpoint_distance(other, me)
    found = trio.filter(fits & between & p.in_direction(beyond, toward, 10, intended=True))
    # the number above, or to the left, is the numerator
    first = F.when(F.abs(oy - my) >= F.abs(ox - mx), my > oy).otherwise(mx < ox)
    return found.select(*on, F.col("a_id").alias("node"), F.col("b_id").alias("bar"), F.col("o_id").alias("other"), g.distance(me, bar).alias("to_bar"), g.distance(me, other).alias("to_other"), first.alias("node_first"))


def fractions(nodes: DataFrame, bars: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, node, bar, other, node_first): greedy fractions; a number or bar is used once.

    Candidates are ranked by number, then by its nearest bar and other number.  A candidate is taken if it ranks first for all three
    of its parts, whose other candidates go; then again among those that are left.  That gives what taking them one by one in the order
    of ranks gives, in as many rounds as the longest chain of candidates that hold one another up, and no page is one task.
    """
    found = fraction_candidates(nodes, bars, on)
    rank = F.struct("node", "to_bar", "bar", "to_other", "other")
    left, taken = stored(found.select(*on, rank.alias("rank"), "node_first"), "candidates"), None
    while not left.isEmpty():
        parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"rank.{c}").alias("id")) for k, c in (("number", "node"), ("bar", "bar"), ("number", "other"))])
        by_part = left.select(*on, "rank", "node_first", F.explode(parts).alias("part"))
        first = by_part.groupBy(*on, "part").agg(F.min("rank").alias("first"))
        wins = shuffled(by_part).join(first, [*on, "part"]).groupBy(*on, "rank", "node_first").agg(F.min((F.col("rank") == F.col("first")).cast("int")).alias("wins"))
        now = stored(wins.filter("wins = 1").drop("wins"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        used = now.select(*on, F.explode(parts).alias("part"))
        touched = shuffled(by_part).join(used, [*on, "part"], "left_semi").select(*on, "rank")
        left = stored(shuffled(left).join(touched, [*on, "rank"], "left_anti"), "candidates")
    return (left if taken is None else taken).select(*on, "rank.node", "rank.bar", "rank.other", "node_first")


def fraction_nodes(nodes: DataFrame, bars: DataFrame, matched: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """Nodes of the fractions' texts, such as 3/4, with the box of their parts; the id is the numerator's."""
    top, low = F.when(F.col("node_first"), F.col("node")).otherwise(F.col("other")), F.when(F.col("node_first"), F.col("other")).otherwise(F.col("node"))
    m = matched.select(*on, top.alias("top"), low.alias("low"), "bar")
    side = lambda name: shuffled(nodes.select(*on, F.col("id").alias(name), F.struct("x0", "y0", "x1", "y1", "text", "left_right").alias(f"{name}_n")))
    joined = shuffled(m).join(side("top"), [*on, "top"]).join(side("low"), [*on, "low"]).join(shuffled(bars).select(*on, F.col("id").alias("bar"), F.struct("x0", "y0", "x1", "y1").alias("bar_n")), [*on, "bar"])
    edge = lambda c, f: f(*[F.col(f"{n}_n.{c}") for n in ("top", "low", "bar")]).alias(c)
    out = joined.select(*on, F.col("top").alias("id"), edge("x0", F.least), edge("y0", F.least), edge("x1", F.greatest), edge("y1", F.greatest), F.concat("top_n.text", F.lit("/"), "low_n.text").alias("text"), F.col("top_n.left_right").alias("left_right"), "top", "low", "bar")
    return out.withColumn("fontsize", F.when(F.col("left_right"), F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0")))


def phrases(glyphs: DataFrame, bars: DataFrame, on: Sequence[str] = ("page",), allow_space: bool = False) -> DataFrame:
    """Glyphs to words, words to fractions, fractions and words to phrases: the last layer."""
    layer1 = stored(words(glyphs, on, allow_space).select(*on, *NODE), "words")
    matched = fractions(layer1, bars, on)
    made = stored(fraction_nodes(layer1, bars, matched, on), "fractions")
    used = made.select(*on, F.explode(F.array("top", "low")).alias("id"))
    layer2 = shuffled(layer1).join(used, [*on, "id"], "left_anti").unionByName(made.select(*on, *NODE))
    layer2 = stored(layer2, "layer2")
    return clustered(layer2, fraction_links(layer2, on), on)


def growing(nodes: DataFrame, on: Sequence[str] = ("page",)) -> DataFrame:
    """(page, id, text, n, box, left_right): texts merged while the box of one, widened by a letter, meets another's.

    A group's box is that of all its members, so words may join through a third one that neither reaches alone; it is widened
    along the reading direction by the largest letter (length over code points) of its members, so a merge never reaches less than
    its parts and the result does not depend on the order of merges.  Upright and turned texts stay apart.  Each round joins
    the groups that grew in the last one with all groups on the grid.  Groups are named by their smallest id; texts are
    read in the order of x0, or of y0 if turned, then id.
    """
    on = [*on]
    keys = [*on, "left_right"]
    letters = F.greatest(F.char_length("text"), F.lit(1))
    size = F.when(F.col("left_right"), F.col("x1") - F.col("x0")).otherwise(F.col("y1") - F.col("y0"))
    texts = nodes.filter(F.col("text").isNotNull())
    groups = stored(texts.select(*keys, "id", *BOX, (size / letters).alias("margin"), F.lit(True).alias("grew")), "groups")
    members = texts.select(*keys, F.col("id").alias("member"), F.col("id"))
    turn = 0
    while True:
        mx, my = F.when(F.col("left_right"), F.col("margin")).otherwise(0.0), F.when(F.col("left_right"), 0.0).otherwise(F.col("margin"))
        wide = groups.select(*keys, "id", "grew", (F.col("x0") - mx).alias("x0"), (F.col("y0") - my).alias("y0"), (F.col("x1") + mx).alias("x1"), (F.col("y1") + my).alias("y1"))
        fresh = (F.col("a_id") != F.col("b_id")) & (F.col("a_grew") | F.col("b_grew"))
        links = stored(intersection(wide, groups.select(*keys, "id", "grew", *BOX), keys, extra=fresh).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "meet")
        if links.isEmpty():
            break
        # groups merge as far as one contraction goes; what it leaves apart still meets in the next round
        turn += 1
        named = contracted(links, turn).withColumnsRenamed({"node": "id", "parent": "to"})
        joined = shuffled(groups).join(named, "id", "left")
        merged = joined.groupBy(*keys, F.coalesce("to", "id").alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("margin").alias("margin"), F.max(F.col("to").isNotNull()).alias("grew"))
        groups = stored(merged, "groups")
        members = stored(shuffled(members).join(named, "id", "left").select(*keys, "member", F.coalesce("to", "id").alias("id")), "members")
    place = F.when(F.col("left_right"), F.col("x0")).otherwise(F.col("y0"))
    own = texts.select(*keys, F.col("id").alias("member"), F.struct(place.alias("at"), F.col("id").alias("i"), "text").alias("item"))
    joined_texts = shuffled(own).join(members, [*keys, "member"]).groupBy(*keys, "id").agg(F.array_sort(F.collect_list("item")).alias("items"), F.min("member").alias("first"))
    text = F.array_join(F.transform("items", lambda v: v["text"]), "")
    return shuffled(groups).join(joined_texts, [*keys, "id"]).select(*on, F.col("first").alias("id"), text.alias("text"), F.size("items").cast("bigint").alias("n"), *BOX, "left_right")
