"""Exact top-k by integer inner product: ball trees in shards, searched by branch and bound.

Every component x becomes floor(256 * x).  Candidates are dealt into shards by a hash of their id; a shard is one row that
holds a built ball tree.  Queries travel in blocks, some blocks to a shard at a time.  A tree's nodes are taken in the order of
their upper bound <q, centre> + |q| * radius and are left out as soon as the bound lies below the k-th score (or equals it, with
no smaller id below).  The k-th score known so far goes along: a block visits one shard first, then two, four, eight more, and
between these rounds every query's best k of all shards visited are put together, so later shards start from a k-th score that
holds for all of them.

Defined results: vectors that are null, empty, hold null or non-finite components, or components whose 256-fold leaves the
doubles take no part; only vectors of a query's own length are its candidates; equal scores go to the smaller id; rows with the
query's own id are no candidates, rows of equal id elsewhere count each; repeated rows of a query's id are queries of their own;
a query with fewer candidates gets them all; a row with a null id takes no part; other columns are not read.  Inner products
are exact up to 126 bits, where they only order (beyond, equal); the score column ends at the bounds of 64 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import written

#: Candidates in a shard, and in a leaf, on average; queries in a block; blocks that visit a shard together.
SHARD_ROWS = 8192
LEAF_ROWS = 64
BLOCK_ROWS = 512
TOGETHER = 16
SCALE = 256
#: Doubles hold integers up to here exactly.
EXACT = 2.0**53
PARTS = (("ids", "<i8"), ("points", "<f8"), ("nodes", "<i8"), ("centre", "<f8"), ("radius", "<f8"), ("least", "<i8"))
FOUND = "dim int, block bigint, place int, query_id bigint, vec_id bigint, hi bigint, lo bigint"


class BallTree:
    """Flat arrays: nodes (first row, end, left, right) in depth-first order, rows of a node side by side."""

    def __init__(self, dim: int, **parts: np.ndarray) -> None:
        self.dim, self.parts = dim, parts
        self.ids, self.radius, self.least = parts["ids"], parts["radius"], parts["least"]
        self.points, self.centre, self.nodes = parts["points"].reshape(-1, dim), parts["centre"].reshape(-1, dim), parts["nodes"].reshape(-1, 4)
        self.largest = float(np.abs(self.points).max())
        with np.errstate(over="ignore"):
            self.slack = 1e-9 * (1 + np.abs(self.centre).max() + self.radius.max())

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> BallTree:
        order = np.arange(len(ids))
        nodes: list[list[int]] = []
        centre, radius, least = [], [], []
        stack = [(0, len(ids), -1, 2)]
        while stack:
            a, b, parent, side = stack.pop()
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            own = points[order[a:b]]
            c = own.mean(axis=0)
            gap = np.sqrt(((own - c) ** 2).sum(axis=1))
            nodes.append([a, b, -1, -1])
            centre.append(c)
            radius.append(gap.max())
            least.append(ids[order[a:b]].min())
            if b - a > LEAF_ROWS and gap.max() > 0:
                far = own[gap.argmax()]
                line = own[((own - far) ** 2).sum(axis=1).argmax()] - far
                order[a:b] = order[a:b][np.argsort(own @ line, kind="stable")]
                middle, here = (a + b) // 2, len(nodes) - 1
                stack += [(middle, b, here, 3), (a, middle, here, 2)]
        return cls(points.shape[1], ids=ids[order], points=points[order].reshape(-1), nodes=np.array(nodes, np.int64).reshape(-1), centre=np.array(centre).reshape(-1), radius=np.array(radius), least=np.array(least, np.int64))

    def search(self, query: np.ndarray, own_id: int, k: int, floor: float) -> list[tuple[int, int]]:
        """(id, score) of the best k here that can still reach the score `floor`, best first, ties to the smaller id."""
        fast = self.largest * float(np.abs(query).max()) * self.dim < EXACT
        with np.errstate(over="ignore", invalid="ignore"):
            length = float(np.sqrt(query @ query))
            bounds = self.centre @ query + length * self.radius + self.slack * (1 + length)
        bounds = np.where(np.isnan(bounds), np.inf, bounds).tolist()
        whole = None if fast else [int(x) for x in query.tolist()]
        best: list[tuple[int, int]] = []  # (-score, id), ascending
        kth, kth_id = floor, np.iinfo(np.int64).max
        heap = [(-bounds[0], 0)]
        while heap:
            bound, n = heapq.heappop(heap)
            if -bound < kth:
                break
            if fast and -bound < kth + 1 and self.least[n] > kth_id:
                continue
            a, b, left, right = self.nodes[n].tolist()
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            ids = self.ids[a:b]
            if fast:
                score = self.points[a:b] @ query
                fit = np.flatnonzero((score >= kth) & (ids != own_id))
                new = [(-int(s), i) for s, i in zip(score[fit].tolist(), ids[fit].tolist(), strict=True)]
            else:
                new = [(-sum(int(x) * y for x, y in zip(p, whole, strict=True)), i) for p, i in zip(self.points[a:b].tolist(), ids.tolist(), strict=True) if i != own_id]
                new = [x for x in new if -x[0] >= kth]
            if new:
                best = sorted(best + new)[:k]
                if len(best) == k and -best[-1][0] >= kth:
                    kth, kth_id = -best[-1][0], best[-1][1]
        return [(i, -s) for s, i in best]


def _whole(vector: Column) -> Column:
    """array<double> of floor(256 * x), null for vectors that take no part."""
    large = float(1 << 52)
    as_double = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * SCALE) < large, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) != float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, as_double)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.asarray(c.flatten()) for c in column.chunks]
    return np.concatenate(parts).reshape(len(column), -1)


def _shards(rows: DataFrame) -> DataFrame:
    """(dim, shard, the parts of a tree): one row for each shard, built once."""

    def build(table: pa.Table) -> pa.Table:
        tree = BallTree.build(table["id"].to_numpy(), _matrix(table["v"]))
        return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1]} | {name: pa.array([tree.parts[name].astype(kind).tobytes()], pa.binary()) for name, kind in PARTS})

    return rows.groupBy("dim", "shard").applyInArrow(build, "dim int, shard bigint, " + ", ".join(f"{name} binary" for name, _ in PARTS))


def _blocks(rows: DataFrame) -> DataFrame:
    """(dim, block, q_ids, q_data): the queries of a block as two byte strings, by id."""

    def pack(table: pa.Table) -> pa.Table:
        ids, points = table["id"].to_numpy(), _matrix(table["v"])
        order = np.lexsort((*points.T[::-1], ids))
        return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "q_ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "q_data": pa.array([points[order].astype("<f8").tobytes()], pa.binary())})

    return rows.groupBy("dim", "block").applyInArrow(pack, "dim int, block bigint, q_ids binary, q_data binary")


def _searched(shard: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """The best k of every query of the blocks in one shard; no rows where either is absent."""
    out: list[tuple] = []
    if shard.num_rows and blocks.num_rows:
        dim = shard["dim"][0].as_py()
        tree = BallTree(dim, **{name: np.frombuffer(shard[name][0].as_py(), kind) for name, kind in PARTS})
        for block, q_ids, q_data, floors in zip(*(blocks[c].to_pylist() for c in ("block", "q_ids", "q_data", "floors")), strict=True):
            ids, queries = np.frombuffer(q_ids, "<i8").tolist(), np.frombuffer(q_data, "<f8").reshape(-1, dim)
            least = {x["place"]: x["s"] for x in floors or []}
            for place, (q_id, query) in enumerate(zip(ids, queries, strict=True)):
                for i, s in tree.search(query, q_id, k, least.get(place, -np.inf)):
                    out.append((dim, block, place, q_id, i, max(min(s >> 63, 1 << 62), -(1 << 62)), s & ((1 << 63) - 1)))
    names = ("dim", "block", "place", "query_id", "vec_id", "hi", "lo")
    types = (pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4)
    return pa.table({n: pa.array([r[c] for r in out], t) for c, (n, t) in enumerate(zip(names, types, strict=True))})


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; salted parts of a query's rows are cut to k before they come together."""
    order = F.struct(F.bitwise_not("hi").alias("h"), F.bitwise_not("lo").alias("l"), F.col("vec_id").alias("i"))
    query = ("dim", "block", "place", "query_id")
    part = found.groupBy(*query, F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))
    return part.groupBy(*query).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))


def _score(hi: Column, lo: Column) -> Column:
    """hi * 2**63 + lo, held to 64 bits."""
    low = F.lit(-(1 << 63))
    return F.when(hi == 0, lo).when(hi == -1, lo + low).when(hi > 0, F.lit((1 << 63) - 1)).otherwise(low)


def top_k(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best other rows.

    Blocks of queries meet shards in an equi-join over a stated list of shards.  A tree travels once for TOGETHER blocks.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), _whole(F.col(vector_col)).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v"))
    rows = written(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    count, parts = 1 + size["n"] // SHARD_ROWS, 1 + size["q"] // BLOCK_ROWS
    # a row's vector takes part in its hash, so that rows of one id spread too
    shards = written(_shards(rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(count)))), "shards")
    blocks = written(_blocks(rows.filter(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit("block")), F.lit(parts)))), "blocks")

    best: DataFrame | None = None
    first = 0
    while first < count:
        last = min(count, 2 * first + 1)
        asked = blocks.withColumn("floors", F.lit(None).cast("array<struct<place: int, s: double>>"))
        if best is not None:
            # a bound a little below the k-th score, which doubles may round
            kth = F.element_at("top", k)
            value = F.bitwise_not(kth["h"]).cast("double") * 2.0**63 + F.bitwise_not(kth["l"]).cast("double")
            floors = best.filter(F.size("top") >= k).select("dim", "block", "place", (value - F.when(F.abs(value) > EXACT / 2, F.abs(value) * 1e-12).otherwise(0)).alias("s"))
            floors = floors.groupBy("dim", "block").agg(F.collect_list(F.struct("place", "s")).alias("floors"))
            asked = blocks.join(floors, ["dim", "block"], "left")
        turn = F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last - 1).cast("bigint")))
        asked = asked.withColumn("turn", turn).withColumn("shard", F.pmod(F.col("block") + F.col("turn"), F.lit(count))).withColumn("crew", F.floor(F.col("block") / TOGETHER))
        crews = asked.select("dim", "shard", "crew").distinct()
        sent = crews.join(shards, ["dim", "shard"])
        visits = asked.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("crew").alias("c"), "block", "q_ids", "q_data", "floors")
        found = sent.groupBy("dim", "shard", "crew").cogroup(visits.groupBy("d", "s", "c")).applyInArrow(lambda a, b: _searched(a, b, k), FOUND)
        if best is not None:
            known = best.select("dim", "block", "place", "query_id", F.explode("top").alias("x")).select("dim", "block", "place", "query_id", F.col("x.i").alias("vec_id"), F.bitwise_not("x.h").alias("hi"), F.bitwise_not("x.l").alias("lo"))
            found = found.unionByName(known)
        best = written(_best(found, k), "best")
        first = last
    if best is None:
        raise AssertionError("there is one shard at least")
    x = F.col("x")
    return best.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), x["i"].alias("vec_id"), _score(F.bitwise_not(x["h"]), F.bitwise_not(x["l"])).alias("score"))


def top_k_sql(k: int = 5, every: int = 50, table: str = "embeddings") -> str:
    """The same by comparing every pair, in DuckDB's SQL."""
    return f"""
    WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM {table}
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM fine q JOIN fine c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
    """
