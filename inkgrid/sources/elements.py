"""Sources and sinks of drawings: elements, symbols, documents, summaries and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PATH = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("pts", T.ArrayType(POINT))]))
ELEMENT = T.StructType(
    [T.StructField("bbox", T.ArrayType(T.DoubleType()))]
    + [T.StructField(n, T.DoubleType()) for n in ("width", "height", "size", "linewidth")]
    + [T.StructField(n, T.StringType()) for n in ("text", "label", "kind")]
    + [T.StructField(n, T.BooleanType()) for n in ("upright", "is_container", "is_annotation", "is_line", "is_rect")]
    + [T.StructField("parent_idx", T.IntegerType()), T.StructField("children_idxes", T.ArrayType(T.IntegerType())), T.StructField("original_path", PATH)]
)
PAGE = T.StructType([T.StructField("pdf_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("elems", T.ArrayType(ELEMENT))])
NODE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parent", T.IntegerType())])
#: Kinds that a page tree is flattened to; containers are descended into and left out unless asked for.
LEAVES = ("char", "curve", "line", "rect")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(pdf_id, content, length): binary files, named by their base name; the content is only read where it is selected."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("pdf_id"), "content", "length")


def read_pages(spark: SparkSession, path: str, page_numbers: Sequence[int] | None = None) -> DataFrame:
    """Pages of element JSON, optionally only some; page_ord counts the pages read."""
    pages = spark.read.schema(PAGE).json(path)
    return pages.filter(F.col("page_number").isin(list(page_numbers))) if page_numbers is not None else pages


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("pdf_id").agg(F.count_distinct("page_number").alias("num_pages"))


def elements(pages: DataFrame, containers: bool = False) -> DataFrame:
    """One row for each element of each page; only the box is required, all else has defaults."""
    e = pages.select("pdf_id", "page_number", F.col("width").alias("page_width"), F.col("height").alias("page_height"), F.posexplode("elems").alias("elem_idx", "e")).filter(F.size("e.bbox") == 4)
    box = [F.element_at("e.bbox", k + 1).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    given = lambda c, d: F.coalesce(F.col(f"e.{c}"), d).alias(c)
    flat = e.select(
        "pdf_id", "page_number", "page_width", "page_height", "elem_idx", *box,
        given("width", F.element_at("e.bbox", 3) - F.element_at("e.bbox", 1)), given("height", F.element_at("e.bbox", 4) - F.element_at("e.bbox", 2)),
        "e.text", "e.label", "e.size", given("linewidth", F.lit(0.0)), given("upright", F.lit(True)),
        *[given(c, F.lit(False)) for c in ("is_container", "is_annotation", "is_line", "is_rect")],
        F.coalesce("e.kind", F.when(F.coalesce("e.is_container", F.lit(False)), "container").when(F.col("e.text").isNotNull(), "char").otherwise("curve")).alias("kind"),
        "e.parent_idx", given("children_idxes", F.array().cast("array<int>")), "e.original_path",
    )
    return flat if containers else flat.filter(F.col("kind").isin(*LEAVES) & ~F.col("is_annotation"))


def leaf_nodes(elems: DataFrame) -> DataFrame:
    """Layer 0: a node for each glyph, and one for each line of some length of every drawn curve."""
    from ..functions import geometry as g

    keys = ["pdf_id", "page_number", "elem_idx"]
    nothing = F.lit(None).cast("double")
    glyphs = elems.filter(F.col("kind") == "char").select(*keys, F.lit(-1).alias("seg_idx"), "x0", "y0", "x1", "y1", "text", "upright", *[nothing.alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    lines = elems.filter((F.col("kind") != "char") & (F.col("linewidth") > 0) & F.col("original_path").isNotNull()).select(*keys, F.posexplode(g.path_lines(F.col("original_path"))).alias("seg_idx", "l"))
    lines = lines.filter((F.col("l.x0") != F.col("l.x1")) | (F.col("l.y0") != F.col("l.y1")))
    line = g.Box(*(F.col(f"l.{c}") for c in ("x0", "y0", "x1", "y1")))
    (x0, x1), (y0, y1) = line.axis(False), line.axis(True)
    drawn = lines.select(*keys, "seg_idx", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("upright"), *[F.col(f"l.{c}").alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    nodes = glyphs.unionByName(drawn)
    derived = g.node_features(g.Box.of(), g.Box.of("l"), F.col("text"), F.col("upright"))
    return nodes.withColumns(derived).withColumn("node_id", F.xxhash64(*keys, "seg_idx"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(name, elem_idx, element) of a symbol library: one JSON object from names to arrays of elements."""
    library = spark.read.option("wholetext", True).text(path).select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(ELEMENT))).alias("m"))
    return library.select(F.explode("m").alias("name", "es")).select("name", F.posexplode("es").alias("elem_idx", "element"))


def cut_symbols(elems: DataFrame, boxes: dict[str, tuple[float, float, float, float]], most: int | None = None) -> DataFrame:
    """(name, elements): elements inside each named box, in order, optionally only the first few."""
    from ..operators.rules import inside_box

    parts = None
    for name, box in boxes.items():
        part = inside_box(elems, box).withColumn("name", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    listed = F.array_sort(F.collect_list(F.struct("elem_idx", "x0", "y0", "x1", "y1", "text")))
    return parts.groupBy("name").agg((F.slice(listed, 1, most) if most else listed).alias("elements"))


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Every row as one JSON text, nulls left out."""
    return df.select(F.to_json(F.struct("*")).alias(out))


def request_id(event: Column | str = "event") -> Column:
    """The document that a request asks for: pdfId of its body, else of the request; null for broken JSON."""
    event = F.col(event) if isinstance(event, str) else event
    return F.coalesce(F.get_json_object(F.get_json_object(event, "$.body"), "$.pdfId"), F.get_json_object(event, "$.body.pdfId"), F.get_json_object(event, "$.pdfId"))


def update_summaries(old: DataFrame, new: DataFrame, key: str = "pdf_id") -> DataFrame:
    """old with the columns of new where keys meet; keys that old lacks are not added (an update, not an insert)."""
    changed = [c for c in new.columns if c != key]
    fresh = new.select(key, F.struct(*changed).alias("_new"))
    joined = old.join(fresh, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("pdf_id",)) -> None:
    """Replaces the partitions that df has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def discard(df: DataFrame) -> None:
    """Runs df and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def visible_to(df: DataFrame, user: str, owner: str = "owner_id") -> DataFrame:
    """Rows of one owner."""
    return df.filter(F.col(owner) == F.lit(user))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing columns added, nulls replaced: what a table's defaults do on insert."""
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})


#: Tables of the element graph; partitioned by document, as their secondary index is.
TABLES = {
    "pdf_summary": "pdf_id STRING, owner_id STRING, created_at TIMESTAMP, summary STRING, house_name STRING, architect_name STRING",
    "pages": "pdf_id STRING, page_number INT, width DOUBLE, height DOUBLE",
    "elems": "id STRING, pdf_id STRING, page_number INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, elem_type STRING, data STRING",
    "links": "pdf_id STRING, from_id STRING, to_id STRING, link_type STRING",
    "progress": "pdf_id STRING, ts TIMESTAMP, seq BIGINT, curr_step INT, total_steps INT, msg STRING, success BOOLEAN",
}


def create_tables(spark: SparkSession, database: str = "drawings") -> list[str]:
    """The tables, where they are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY (pdf_id)")
    return [f"{database}.{name}" for name in TABLES]
