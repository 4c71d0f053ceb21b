"""Near-duplicate documents by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  ROWS independent hash functions each deal the
shingles into BANDS buckets; a bucket's register keeps the leading zeros and some mantissa bits of its smallest hash (16 bits).
Band i takes one register of every function, so its rows are independent.  Documents with equal sets are one class from the
start.  Candidates are classes that share a band; registers give a Jaccard estimate, corrected for chance collisions; the full
sets confirm.  Confirmed links become components.

Groups are never expanded: in buckets of more than SMALL classes, members meet one hub, another in most bands.  Where such a
bucket still spans several components afterwards, its members outside the main component are compared with all members, block by
block, which finds the remaining links.  Blocks are bounded by the shingles they hold; joins by bucket are merge joins, whose crowded
keys Spark splits.

Defined results: a null or empty text has an empty set, no links and its own component; shorter texts than five words are one
shingle; rows of equal id are one document, linked through each of their sets; a row with a null id has no links, a null
component and is kept; an empty table gives no rows; other columns are not read by `classes` and kept by `keep_first`.  Ids are
integers.  64-bit hashes stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, written
from ._text import U64, flat, mix, runs, settled, shingles, spans_hash, words
from .components import components

ROWS, BANDS = 5, 51
VALUE_BITS, MANTISSA = 48, 10
EMPTY = U64((1 << VALUE_BITS) - 1)
#: Buckets up to this size give all their pairs.
SMALL = 8
#: Estimates this far below the threshold are confirmed on full sets too: over five standard errors of 255 registers.
MARGIN = 0.14
#: Large buckets choose their hubs in so many orders, so that classes which share several of them meet few hubs.
FAMILIES = 8
#: Shingles of a block, on average, when a large bucket is compared block by block.
BLOCK = 1 << 17
#: Fixed value: the constant of the expected-collision formula published for HyperMinHash.
COLLISION = 0.169919487159739093975315012348


def document_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document, hash) of distinct shingles, both ascending, and the number of documents, for runs of documents."""
    raw_all, off = flat(texts)
    for a, b in runs(off):
        raw, offsets = raw_all[off[a] : off[b]], off[a : b + 1] - off[a]
        start, end, first = words(raw, offsets)
        doc, key = shingles(spans_hash(raw, start, end), first, n)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        if len(doc):
            fresh = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]
            doc, key = doc[fresh], key[fresh]
        yield doc, key, b - a


def registers(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """uint16[n, ROWS * BANDS]: 0xFFFF where no shingle fell, else leading zeros and mantissa of the smallest hash."""
    least = np.full(n * ROWS * BANDS, EMPTY, dtype=U64)
    for f in range(ROWS):
        h = mix(key + U64((f + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bucket = ((h >> U64(48)) * U64(BANDS) >> U64(16)).astype(np.int64)
        np.minimum.at(least, doc * (ROWS * BANDS) + f * BANDS + bucket, h & EMPTY)
    _, exponent = np.frexp(least.astype(np.float64))
    exponent = np.clip(exponent, 1, VALUE_BITS)
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(U64)
    mantissa = (least >> shift) & U64((1 << MANTISSA) - 1)
    out = ((VALUE_BITS - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    out[least == EMPTY] = 0xFFFF
    return out.reshape(n, ROWS * BANDS)


def _orders() -> list[np.ndarray]:
    """A fixed order of the buckets for every function."""
    return [np.argsort(mix(np.arange(BANDS, dtype=U64) + U64(1000 * (f + 1)))) for f in range(ROWS)]


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """uint64[n, BANDS]; an empty register is filled from another of its function, found in a fixed pseudo-random order."""
    n = len(regs)
    value = regs.reshape(n, ROWS, BANDS).astype(U64)
    for step in range(64):
        empty = value == U64(0xFFFF)
        if not empty.any():
            break
        order = np.argsort(mix(np.arange(BANDS, dtype=U64) + U64(77 * (step + 1))))
        source = regs.reshape(n, ROWS, BANDS)[:, :, order].astype(U64)
        value = np.where(empty & (source != U64(0xFFFF)), source + U64((step + 1) << 20), value)
    h = np.repeat(mix(np.arange(1, BANDS + 1, dtype=U64))[None], n, axis=0)
    for f, order in enumerate(_orders()):
        h = mix(h * U64(0x9FB21C651E98DF25) + value[:, f, order])
    return h


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of register rows, corrected for registers that agree by chance."""
    used = (a != 0xFFFF) | (b != 0xFFFF)
    same = ((a == b) & used).sum(axis=-1)
    n = used.sum(axis=-1)
    large, small = np.maximum(size_a, size_b).astype(float), np.maximum(1, np.minimum(size_a, size_b)).astype(float)
    ratio = large / small
    chance = 4 * ratio / (1 + ratio) ** 2 * COLLISION * 2.0**-MANTISSA * n
    return np.clip((same - chance) / np.maximum(n, 1), 0, 1)


def digests(key: np.ndarray, count: np.ndarray) -> list[bytes]:
    """128 bits of each set, given the hashes of all sets one after the other and their sizes."""
    end = np.cumsum(count)
    pair = np.zeros((len(count), 2), dtype=U64)
    for k, salt in enumerate((0, 0xA0761D6478BD642F)):
        total = np.r_[U64(0), np.cumsum(mix(key ^ U64(salt)))]
        pair[:, k] = total[end] - total[end - count]
    return [row.tobytes() for row in pair]


def sketch_column(text: Column) -> Column:
    """struct(n, digest, regs): size of the set, 128 bits that equal sets share, and the registers."""

    @F.arrow_udf("struct<n: bigint, digest: binary, regs: binary>")
    @settled
    def sketch(texts: pa.Array) -> pa.Array:
        size, digest, regs = [], [], []
        for doc, key, n in document_sets(texts):
            count = np.bincount(doc, minlength=n)
            size.append(count)
            digest += digests(key, count)
            regs += [row.tobytes() for row in registers(doc, key, n)]
        size = np.concatenate(size) if size else np.zeros(0, np.int64)
        full = (size > 0).tolist()
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array([d if f else None for d, f in zip(digest, full, strict=True)], pa.binary()), pa.array([r if f else None for r, f in zip(regs, full, strict=True)], pa.binary())], ["n", "digest", "regs"])

    return sketch(text)


def _regs(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.uint16).reshape(-1, ROWS * BANDS)


@settled
def _bands_of(regs: pa.Array) -> pa.Array:
    every = _regs(regs)
    h = np.concatenate([np.zeros((0, BANDS), U64), *(band_hashes(every[k : k + 1000]) for k in range(0, len(every), 1000))]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BANDS, dtype=np.int32)), pa.array(h.reshape(-1)))


@settled
def _estimated_of(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    x, y, n, m = _regs(a), _regs(b), n_a.to_numpy(), n_b.to_numpy()
    return pa.array(np.concatenate([np.zeros(0), *(estimate(x[k : k + 1000], y[k : k + 1000], n[k : k + 1000], m[k : k + 1000]) for k in range(0, len(x), 1000))]), pa.float64())


@settled
def _set_of(texts: pa.Array) -> pa.Array:
    """struct(s, digest) of each text."""
    keys, counts, digest = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], []
    for doc, key, n in document_sets(texts):
        keys.append(key.view(np.int64))
        counts.append(np.bincount(doc, minlength=n))
        digest += digests(key, counts[-1])
    s = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(keys)))
    return pa.StructArray.from_arrays([s, pa.array(digest, pa.binary())], ["s", "digest"])


@settled
def _common_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sizes of the intersections of pairs of distinct sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.concatenate([np.asarray(x.values), np.asarray(y.values)])
        both.sort()
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def _outside(large: DataFrame, links: _Links) -> DataFrame:
    """Links (a, b) between components of the clusters of large (rep, comp, first: any class of the same cluster).

    Members outside a cluster's main component are compared with all its members, in blocks of both: (cluster, part of the
    outside, part of the cluster) is a group of bounded size.  Registers that look alike enough are confirmed on full sets there.
    """
    cluster = components(large.select(F.col("rep").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    member = written(large.select("rep", "comp").distinct().join(cluster, "rep").join(links.reps.select("rep", "n"), "rep"), "members")
    size = member.groupBy("cluster", "comp").agg(F.sum("n").alias("n"))
    main = size.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    parts = main.select("cluster", "main", (F.floor((F.col("n") - 1) / BLOCK) + 1).cast("int").alias("parts"), F.greatest(F.floor((F.col("n") - F.col("most") - 1) / BLOCK) + 1, F.lit(0)).cast("int").alias("outer"))
    work = member.join(parts.filter(F.col("outer") > 0), "cluster")
    sets = links.sets(links.reps.join(work.select("rep"), "rep", "left_semi"))
    row = work.join(links.reps.select("rep", "regs"), "rep").join(sets, "rep").withColumn("h", F.xxhash64("rep"))
    every = row.select("cluster", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), F.pmod("h", "parts").cast("int").alias("j"), F.lit(False).alias("asks"), "rep", "comp", "n", "regs", "s")
    outer = row.filter(F.col("comp") != F.col("main")).select("cluster", F.pmod("h", "outer").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("asks"), "rep", "comp", "n", "regs", "s")
    percent = links.percent
    return written(every.unionByName(outer).groupBy("cluster", "i", "j").applyInArrow(lambda t: _confirmed(t, percent), "a bigint, b bigint"), "outside")


@settled
def _confirmed(table: pa.Table, percent: int) -> pa.Table:
    """Links of the asking rows with the others, of other components, of one block."""
    asks = table["asks"].to_numpy()
    rep, comp, n = (table[c].to_numpy() for c in ("rep", "comp", "n"))
    regs = _regs(table["regs"])
    s = table["s"].combine_chunks()
    s = pa.concat_arrays(s.chunks) if isinstance(s, pa.ChunkedArray) else s
    values, at = np.asarray(s.flatten()), np.r_[0, np.cumsum(n)]
    rest = np.flatnonzero(~asks)
    a, b = [], []
    for k in np.flatnonzero(asks).tolist():
        near = rest[(comp[rest] != comp[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))]
        if not len(near):
            continue
        near = near[estimate(regs[near], regs[k][None], n[near], n[k]) >= percent / 100 - MARGIN]
        own = np.sort(values[at[k] : at[k + 1]])
        for m in near.tolist():
            other = values[at[m] : at[m + 1]]
            spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
            common = int((own[spot] == other).sum())
            if 100 * common >= percent * (n[k] + n[m] - common):
                a.append(min(rep[k], rep[m]))
                b.append(max(rep[k], rep[m]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class _Links:
    """The classes of a table of documents and what is known about their links."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int) -> None:
        self.docs, self.reps, self.percent = docs, reps, percent
        self.least = percent / 100 - MARGIN
        self.labels: DataFrame | None = None

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose registers allow a link, with the estimate."""
        regs = self.reps.select("rep", "n", "regs")
        x = regs.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        y = regs.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        fit = (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        joined = pairs.join(x, "a").join(y, "b").filter(fit)
        return joined.withColumn("e", F.arrow_udf(_estimated_of, "double")("ra", "rb", "na", "nb")).filter(F.col("e") >= self.least).select("a", "b", "e", "na", "nb")

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Joins the components of pairs (a, b) with 100 * intersection >= percent * union."""
        x = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"))
        y = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
        common = F.arrow_udf(_common_of, "bigint")("sa", "sb")
        if pairs.isEmpty():
            return
        found = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common.alias("c"))
        self.merge(written(found.filter(100 * F.col("c") >= self.percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b"), "links"))

    def named(self, pairs: DataFrame) -> DataFrame:
        """pairs with the components ca, cb of their ends, where these differ."""
        x = self.labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        y = self.labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(x, "a").join(y, "b").filter(F.col("ca") != F.col("cb"))

    def merge(self, links: DataFrame) -> None:
        """Joins the components of linked nodes, if any; only components enter the contraction, not their members."""
        if links.isEmpty():
            return
        between = self.named(links).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        above = components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
        self.labels = written(self.labels.join(above, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(rep, s): the full shingle sets of the classes that take part in pairs."""
        nodes = nodes.select("rep", "doc", "digest")
        first = self.docs.join(nodes.select("doc"), "doc", "left_semi").select("doc", F.arrow_udf(_set_of, "struct<s: array<bigint>, digest: binary>")("text").alias("k"))
        # of rows with equal ids, one whose set is the class's
        return written(first.select("doc", "k.digest", "k.s").join(nodes, ["doc", "digest"]).select("rep", "s").dropDuplicates(["rep"]), "sets")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept: the row's id is its component's smallest."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    sketched = written(rows.select("doc", sketch_column(F.col("text")).alias("k")).select("doc", "k.n", "k.digest", "k.regs"), "sketches", compact=True)
    full = sketched.filter(F.col("doc").isNotNull() & (F.col("n") > 0))
    found = full.groupBy("digest", "n").agg(F.min(F.struct("doc", "regs")).alias("m")).select("digest", "n", "m.doc", "m.regs")
    found = found.select("digest", "n", "doc", F.col("doc").alias("rep"), "regs", F.arrow_udf(_bands_of, "array<bigint>")("regs").alias("bands"))
    links = _Links(rows, _named(written(found, "classes")), percent)
    member = sketched.select("doc", "digest").filter(F.col("digest").isNotNull() & F.col("doc").isNotNull()).join(links.reps.select("digest", "rep"), "digest").select("doc", "rep")
    # rows of equal id are one document: all its sets link to one of them
    own = member.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter(F.col("a") < F.col("z")).select("doc", "a")
    twins = written(member.join(own, "doc").filter(F.col("a") != F.col("rep")).select("a", F.col("rep").alias("b")), "twins")

    band = links.reps.select("rep", F.explode("bands").alias("h"))
    hub = F.min(F.struct(F.xxhash64(F.pmod("h", F.lit(FAMILIES)), "rep").alias("o"), F.col("rep").alias("rep")))["rep"]
    shared = band.groupBy("h").agg(F.count("*").alias("m"), hub.alias("hub")).filter(F.col("m") > 1)
    bucket = written(band.join(shared.hint("merge"), "h"), "buckets")
    near = bucket.filter(F.col("m") <= SMALL).groupBy("h").agg(F.array_sort(F.collect_list("rep")).alias("r"))
    pair = F.expr("flatten(transform(r, (x, i) -> transform(slice(r, i + 2, size(r)), y -> struct(x as a, y as b))))")
    pairs = near.select(F.explode(pair).alias("p")).select("p.a", "p.b")
    stars = bucket.filter((F.col("m") > SMALL) & (F.col("rep") != F.col("hub"))).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    candidates = written(links.estimated(pairs.union(stars).distinct()), "candidates")

    ends = candidates.select(F.col("a").alias("rep")).union(candidates.select("b")).distinct()
    sets = links.sets(links.reps.join(ends, "rep", "left_semi"))
    crowded = bucket.filter(F.col("m") > SMALL)
    links.labels = written(ends.union(crowded.select("rep")).union(twins.select("a")).union(twins.select("b")).distinct().select(F.col("rep").alias("node"), F.col("rep").alias("component")), "labels")
    # first every class's most similar partner, which joins most groups; then whatever still lies between components
    links.confirm(_best(candidates), sets)
    links.confirm(written(links.named(candidates), "open"), sets)

    # crowded buckets that still span components: those that share classes are one cluster
    large = crowded.join(links.labels, F.col("rep") == F.col("node")).select("h", "rep", F.col("component").alias("comp"))
    mixed = large.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("rep").alias("first")).filter(F.col("x") < F.col("y")).select("h", "first")
    large = written(large.join(mixed.hint("merge"), "h").select("rep", "comp", "first").distinct(), "large")
    if not large.isEmpty():
        links.merge(_outside(large, links))

    links.merge(twins)
    # a component's name is its smallest document, not its smallest class
    named = member.join(links.labels, F.col("rep") == F.col("node"), "left").select("doc", F.coalesce("component", "rep").alias("label"))
    least = named.groupBy("label").agg(F.min("doc").alias("component"))
    named = named.groupBy("doc").agg(F.min("label").alias("label")).join(least, "label").select("doc", "component")
    out = sketched.select("doc", "n").join(named, "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def _named(classes: DataFrame) -> DataFrame:
    """classes (digest, doc, rep and more) with distinct rep: of an id's several sets, all but one are named by their digest."""
    several = classes.groupBy("doc").agg(F.min("digest").alias("main"), F.count("*").alias("sets")).filter(F.col("sets") > 1)
    if several.isEmpty():
        return classes
    other = F.xxhash64("digest").bitwiseOR(F.lit(-(1 << 63)))
    joined = classes.join(several.select("doc", "main"), "doc", "left")
    return written(joined.withColumn("rep", F.when(F.col("main").isNull() | (F.col("main") == F.col("digest")), F.col("doc")).otherwise(other)).select(classes.columns), "classes")


def _best(pairs: DataFrame) -> DataFrame:
    """The pair of the highest estimate of every end, from pairs (a, b, e)."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "e").union(pairs.select("b", "a", "e"))
    return both.groupBy("x").agg(F.max_by("y", F.struct("e", "y")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: the one with its smallest id (each row of that id)."""
    away = classes(docs, id_col, text_col, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(away, id_col, "left_anti")


def classes_sql(percent: int = 75, table: str = "documents") -> str:
    """classes() by comparing every two documents that share a shingle, in DuckDB's SQL: for small tables."""
    return f"""
    WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
    spots AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM texts),
    sets AS (SELECT DISTINCT doc_id, w[i:i+4] AS s FROM spots),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT doc_id AS node, doc_id AS other FROM texts UNION SELECT r.node, w.b FROM reached r JOIN ways w ON r.other = w.a),
    least AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM texts LEFT JOIN sizes USING (doc_id) JOIN least ON node = doc_id
    """
