"""Connected components of an edge table by contraction, without collecting nodes or edges.

Every round each node hooks to the neighbour (or itself) of smallest priority, a hash of the node, and edges move to the
hooks; self-edges and repeats vanish, so the table shrinks by a constant share in expectation whatever the shape of the
graph.  Hooks are written to the shared folder and followed backwards at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b: bigint); component is the smallest node id reachable.

    Null ends are ignored; an empty table gives no rows; repeated edges and self-edges are allowed.
    """
    now = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = written(now.select("a", "b"), "edges")
    steps: list[DataFrame] = []
    now = nodes.filter(F.col("a") != F.col("b")).distinct()
    seed = 0
    while True:
        now = written(now, "edges")
        if now.isEmpty():
            break
        seed += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["n"].alias("to"))
        hook = written(hook, "hooks")
        steps.append(hook)
        now = now.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    every = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    if not steps:
        return every.withColumn("component", F.col("node"))
    roots = steps[-1]
    for hook in reversed(steps[:-1]):
        above = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = hook.join(above, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    rooted = written(every.join(roots, "node", "left").select("node", F.coalesce("to", "node").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(least, "root").select("node", "component")
