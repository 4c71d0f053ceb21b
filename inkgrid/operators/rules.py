"""Schedule rules: where they apply, which labels they match, what is near a label.

A rule is a row of data: its schedule, page, row id and kind.  Registered kinds stand in RULES; a kind compiles to a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import texts as t
from ..functions.geometry import Box
from .boxes import bounding
from .graph import shuffled, stored
from .spatial import containment


@dataclass(frozen=True)
class RuleKind:
    """Key text of the schedule, its name, whether ## is a wildcard, whether each page starts anew, where the header stands."""

    key_text: str
    schedule: str
    wildcard: bool = False
    per_page: bool = False
    header_above: bool = False


RULES = (RuleKind("door schedule", "doors"), RuleKind("window schedule", "windows", wildcard=True), RuleKind("lighting legend", "lighting", per_page=True, header_above=True))


def validity(schedules: DataFrame, by: Sequence[str], order: str, tie: str) -> DataFrame:
    """Schedules with `next_order`: where the following one takes over."""
    w = Window.partitionBy(*by).orderBy(order, tie)
    return schedules.withColumn("next_order", F.lead(order).over(w))


def in_force(marks: DataFrame, schedules: DataFrame, by: Sequence[str], order: str, tie: str, mark_order: str | None = None) -> DataFrame:
    """Each mark with the latest schedule at or before it (as-of); marks before the first have none and are left out.

    One shuffle by `by`: marks and schedules are merged in order and the last schedule is carried forward, so a document with very
    many of both makes no pairs.  Of schedules at one place the last by `tie` counts.
    """
    mark_order = mark_order or order
    s = schedules.select(*by, F.col(order).alias("_o"), F.lit(0).alias("_k"), F.col(tie).alias("_t"), F.struct(*[F.col(c) for c in schedules.columns if c not in by]).alias("_s"))
    m = marks.select(*by, F.col(mark_order).alias("_o"), F.lit(1).alias("_k"), F.lit(None).cast(dict(schedules.dtypes)[tie]).alias("_t"), F.struct(*[F.col(c) for c in marks.columns if c not in by]).alias("_m"))
    both = s.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_o", "_k", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_last", F.last("_s", ignorenulls=True).over(w)).filter((F.col("_k") == 1) & F.col("_last").isNotNull())
    taken = [c for c in schedules.columns if c not in by]
    names = {c: f"schedule_{c}" if c in marks.columns else c for c in taken}
    return carried.select(*by, *[F.col(f"_m.{c}").alias(c) for c in marks.columns if c not in by], *[F.col(f"_last.{c}").alias(names[c]) for c in taken])


def on_same_page(marks: DataFrame, schedules: DataFrame, by: Sequence[str], page: str) -> DataFrame:
    """Marks with every schedule of their own page: kinds that start anew on each page."""
    return shuffled(marks).join(schedules, [*by, page])


#: Ids of labels or rules that travel together.
CHUNK = 1024


def _chunks(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name): the ids of each key in arrays of about CHUNK."""
    many = df.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("_n"))
    dealt = shuffled(df).join(many, list(keys)).withColumn("_k", F.pmod(F.xxhash64(name), F.col("_n")))
    return dealt.groupBy(*keys, "_k").agg(F.collect_list(name).alias(name)).drop("_k")


def label_matches(labels: DataFrame, rules: DataFrame, by: Sequence[str] = ("page",), wildcard: bool = False) -> DataFrame:
    """(page, id, rule_id, label): labels that a rule's id matches; an empty id matches nothing.

    Ids without special characters are an equi-join on the label without its last line break or space; only the others are
    tried as regular expressions, on the labels of their page.  Every different text of a page meets every different id once; the labels
    and rules that have them meet in chunks, which are dealt over tasks, so a text and a pattern that many have are no single task.
    """
    by = list(by)
    some = rules.filter(F.col("row_id") != "").select(*by, "rule_id", "row_id")
    own = stored(some.withColumn("literal", t.is_literal(F.col("row_id"))).groupBy(*by, "row_id").agg(F.first("literal").alias("literal")), "rules")
    texts = stored(labels.filter(F.col("text").isNotNull()).select(*by, "text").distinct(), "texts")
    literal = own.filter("literal").select(*by, "row_id", F.col("row_id").alias("label"))
    equal = texts.withColumn("label", t.label_body(F.col("text"))).join(literal, [*by, "label"]).select(*by, "text", "row_id", "label")
    pattern = own.filter(~F.col("literal")).select(*by, "row_id", t.label_pattern(F.col("row_id"), wildcard).alias("pattern"))
    tried = texts.join(pattern, by).filter(F.expr("regexp_like(text, pattern)")).select(*by, "text", "row_id", F.expr("regexp_extract(text, pattern, 1)").alias("label"))
    matched = stored(equal.unionByName(tried).filter(F.col("label") != ""), "matched")
    held = _chunks(labels.select(*by, "text", "id"), [*by, "text"], "id").withColumnRenamed("id", "ids")
    pairs = shuffled(matched).join(held, [*by, "text"]).join(shuffled(_chunks(some, [*by, "row_id"], "rule_id")), [*by, "row_id"])
    # their number is given, since few bytes of chunks become very many rows
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select(*by, "ids", F.col("rule_id").alias("rule_ids"), "label").repartition(tasks, F.xxhash64("ids", "rule_ids"))
    return dealt.select(*by, "label", "rule_ids", F.explode("ids").alias("id")).select(*by, "id", F.explode("rule_ids").alias("rule_id"), "label")


def near_label(matches: DataFrame, elems: DataFrame, reach: Column | float, by: Sequence[str] = ("page",)) -> DataFrame:
    """Elements inside the box of each label grown by the symbol's reach (and ten more)."""
    grown = Box.of().grown(F.lit(reach) + 10 if isinstance(reach, (int, float)) else reach + 10)
    windows = matches.select(*[c for c in matches.columns if c not in ("x0", "y0", "x1", "y1")], grown.x0.alias("x0"), grown.y0.alias("y0"), grown.x1.alias("x1"), grown.y1.alias("y1"))
    return containment(windows, elems, by)


def highlight(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounding box of a label and the curves that matched it."""
    return parts.groupBy(*by).agg(*bounding())


def attach(results: DataFrame, cells: DataFrame, by: Sequence[str] = ("schedule", "page", "row")) -> DataFrame:
    """Results with the cells of the schedule row that they point to."""
    return results.join(cells, list(by))


def regex_rule(make: Callable[[Column], Column], rules: DataFrame) -> DataFrame:
    """Rules with a pattern made from their id by a given column function."""
    return rules.withColumn("pattern", make(F.col("row_id")))


def inside_box(elems: DataFrame, box: tuple[float, float, float, float], margin: float = 0.0) -> DataFrame:
    """Elements inside a literal box."""
    x0, y0, x1, y1 = box
    return elems.filter(p.contains(Box(*map(F.lit, (x0 - margin, y0 - margin, x1 + margin, y1 + margin))), Box.of()))
