"""The element graph: questions over elements and typed links, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def instances_of(elems: DataFrame, links: DataFrame, attribute: str, link_type: str = "instance_of") -> DataFrame:
    """(attribute, n): how many elements are instances of rows with each value of an attribute."""
    rows = elems.filter(F.col("elem_type") == "schedule_row").select(F.col("id").alias("to_id"), attribute)
    return links.filter(F.col("link_type") == link_type).join(rows, "to_id").groupBy(attribute).agg(F.count_distinct("from_id").alias("n"))


def linked_to(elems: DataFrame, links: DataFrame, link_type: str) -> DataFrame:
    """Elements that have a link of a type to some element (semi-join)."""
    return elems.join(links.filter(F.col("link_type") == link_type).select(F.col("from_id").alias("id")), "id", "left_semi")


def summed_over_rows(elems: DataFrame, links: DataFrame, values: DataFrame) -> DataFrame:
    """(attribute, total): values of elements summed by the attribute of the row they are instances of.

    Three equi-joins: element to link, link to row, element to value.
    """
    rows = elems.filter(F.col("elem_type") == "schedule_row").select(F.col("id").alias("to_id"), "mnfct")
    found = links.filter(F.col("link_type") == "instance_of").join(rows, "to_id").join(values.select(F.col("id").alias("from_id"), "value"), "from_id")
    return found.groupBy("mnfct").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def field(data: Column, name: str, as_type: str = "string") -> Column:
    """A field of an element's JSON data; null where the field, or valid JSON, is missing."""
    return F.try_variant_get(F.try_parse_json(data), f"$.{name}", as_type)


def area_by_finish(elems: DataFrame, links: DataFrame, finish: str) -> DataFrame:
    """(finish, rooms, square_feet): areas of the rooms whose schedule row has a cell with that finish.

    The path is cell to row by its link, row to room by the room's name, room to its areas.  A room counts once for
    each finish, however many rows and cells say so; rooms that no such cell leads to are summed under a null finish.
    """
    of = lambda kind: elems.filter(F.col("elem_type") == kind)
    cells = of("schedule_cell").select(F.col("id").alias("from_id"), field(F.col("data"), finish).alias("finish")).filter(F.col("finish").isNotNull())
    rows = of("schedule_row").select(F.col("id").alias("to_id"), field(F.col("data"), "name_of_room").alias("room")).filter(F.col("room").isNotNull())
    finishes = links.filter(F.col("link_type") == "cell_of_row").join(cells, "from_id").join(rows, "to_id").select("finish", "room").distinct()
    areas = of("square_feet").select(field(F.col("data"), "name_of_room").alias("room"), field(F.col("data"), "square_feet", "double").alias("area")).groupBy("room").agg(F.sum("area").alias("area"))
    return areas.join(finishes, "room", "left").groupBy("finish").agg(F.count("*").alias("rooms"), F.sum("area").alias("square_feet"))


def keys_linked(elems: DataFrame, links: DataFrame) -> DataFrame:
    """(elem_type, link_type): which types of elements have which links."""
    return elems.join(links, elems["id"] == links["from_id"]).select("elem_type", "link_type").distinct()


def hover(elems: DataFrame, links: DataFrame) -> DataFrame:
    """(id, row_id, kind, other): for each cell its row, the row's other cells, and the row's instances."""
    cells = links.filter(F.col("link_type") == "cell_of_row").select(F.col("from_id").alias("id"), F.col("to_id").alias("row_id"))
    others = links.select(F.col("to_id").alias("row_id"), F.col("from_id").alias("other"), F.when(F.col("link_type") == "cell_of_row", "sibling").otherwise("instance").alias("kind"))
    return cells.join(others, "row_id").filter(F.col("other") != F.col("id")).select("id", "row_id", "kind", "other")


def members(elems: DataFrame, column: str, ids: list) -> DataFrame:
    """Elements whose column is one of a list of values."""
    return elems.filter(F.col(column).isin(ids))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; only in local mode may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "/tmp/checkpoints"


def shuffled(df: DataFrame) -> DataFrame:
    """df, which a join sorts and merges instead of collecting it on the driver for a broadcast.

    Cells, glyphs and elements are many rows from few bytes of a table, so sizes estimated from files say nothing of them.
    """
    return df.hint("merge")


def stored(df: DataFrame, name: str, merged: bool = True) -> DataFrame:
    """df written below the shared checkpoint folder and read again: cuts the lineage, survives lost executors.

    Joins do not broadcast it, unless `merged` is False: its files are far smaller than its rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    return shuffled(found) if merged else found


def contracted(links: DataFrame, turn: int) -> DataFrame:
    """(node, parent): a node of its own component for each node of links (a, b), the same one for many of them.

    Every node hooks to the smallest of itself and its neighbours in an order that is hashed anew in each turn, and then to what that one
    hooks to.  Links between parents connect what the links connected.
    """
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("n"))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    hook = ends.groupBy("node").agg(F.min(order("other")).alias("o"), F.min(order("node")).alias("s")).select("node", F.least("o", "s")["n"].alias("parent"))
    further = hook.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
    return stored(shuffled(hook).join(further, "parent").select("node", F.col("next").alias("parent")), "hooks")


def descended(hooks: DataFrame) -> DataFrame:
    """(node, component): where each node of (a, b), one row for each a, arrives by going on to b as long as that is smaller.

    Every round doubles the steps, so rounds follow the logarithm of the longest way down.
    """
    at = stored(hooks.select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
    while True:
        further = at.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        moved = at.join(further, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.coalesce(F.col("next") != F.col("parent"), F.lit(False)).alias("moved"))
        moved = stored(moved, "parents")
        at = moved.select("node", "parent")
        if moved.filter("moved").isEmpty():
            return at.withColumnRenamed("parent", "component")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node reachable either way.

    Contracts the links until none is left, so rounds follow the logarithm of the size and not the longest path; nothing is collected.
    """
    links = stored(links.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull()), "links")
    left, hooks = links.filter(F.col("a") != F.col("b")), []
    while not left.isEmpty():
        hook = contracted(left, len(hooks) + 1)
        hooks.append(hook)
        to = lambda c: hook.select(F.col("node").alias(c), F.col("parent").alias(f"{c}2"))  # noqa: B023, E731
        moved = shuffled(left).join(to("a"), "a").join(shuffled(to("b")), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        left = stored(moved.filter(F.col("a") != F.col("b")).distinct(), "left")
    nodes = shuffled(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")))
    for hook in hooks:
        nodes = nodes.join(shuffled(hook.select(F.col("node").alias("root"), "parent")), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    nodes = stored(nodes, "roots") if hooks else nodes
    return shuffled(nodes).join(nodes.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
