"""Line deduplication by probing sharded minimal perfect hashes.

Lines whose key occurs in several documents stay only in the document of smallest id.  Documents stand in batches.  A batch sends
the distinct 64-bit hashes of its lines' keys, packed by the shard that their leading bits name, with the smallest and largest id
that holds each.  A shard indexes all its distinct hashes by a minimal perfect hash (levels of bit arrays, in which a key's slot
is its rank among the set bits) over arrays of compact fingerprints, counts of holders, and first documents of the repeated ones.
Batches then probe these arrays with their packed hashes: slot, fingerprint, count, first document.  A batch asks for a line once,
however many of its documents hold it, so frequent lines make no task larger.  Texts are joined only with the hashes to drop.

A key is the line without white space (space, 0x09-0x0D) at both ends, A-Z as a-z; keys of fewer than `least` code points never
drop.  Defined results: a null or empty text is one empty line; a row with a null id never counts as a holder, and loses the
lines that repeat among the others; rows of equal id are one document, whose repeated lines within itself stay; an empty table
gives no rows; other columns are kept.  Ids are integers; 64-bit hashes stand for keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, written
from ._text import U64, flat, mix, runs, settled, spans_hash, words

#: Hashes that a shard is asked for, on average; the number of shards follows the number of lines.
SHARD_KEYS = 1 << 17
#: The largest count that the arrays tell apart.
MOST = 255
GAMMA = 1.3
LEVELS = 48


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys with values in arrays of the same order."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray) -> None:
        self.bits, self.rest = bits, rest
        self.sizes = sizes
        self.rank = []
        before = 0
        for b in bits:
            c = np.cumsum(b, dtype=np.int64)
            self.rank.append(c - 1 + before)
            before += int(c[-1]) if len(c) else 0
        self.before_rest = before

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys: at each level the keys that are alone in their slot stay; the others go on."""
        sizes, bits, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = max(8, int(len(left) * GAMMA))
            slot = cls._slot(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[slot]]
        return cls(sizes, bits, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in 0..n-1; any place, or -1, for other keys."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, b) in enumerate(zip(self.sizes, self.bits, strict=True)):
            if not len(todo):
                return out
            slot = self._slot(keys[todo], level, size)
            hit = b[slot]
            out[todo[hit]] = self.rank[level][slot[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            spot = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[spot] == keys[todo]
            out[todo[hit]] = self.before_rest + spot[hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.rest), *self.sizes], dtype="<i8").tobytes()
        return head + self.rest.astype("<u8").tobytes() + b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n, rest = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", n, 16).tolist()
        at = 16 + 8 * n
        left = np.frombuffer(data, "<u8", rest, at)
        at += 8 * rest
        bits = []
        for size in sizes:
            width = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(sizes, bits, left)


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of all lines."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    count = 1 + np.diff(np.searchsorted(breaks, offsets))
    return starts, ends, np.repeat(np.arange(len(count)), count)


def line_keys(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines that have a key of at least `least` code points, the keys' hashes)."""
    ws, we, _ = words(raw, offsets)
    first, last = np.searchsorted(ws, starts), np.searchsorted(we, ends, side="right") - 1
    some = np.flatnonzero(last >= first)
    a, b = ws[first[some]], we[last[some]]
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    long_enough = points[b] - points[a] >= least
    return some[long_enough], spans_hash(raw, a[long_enough], b[long_enough])


class LineIndex:
    """The distinct hashes of a shard: fingerprints and counts by slot, and the first document of each repeated hash in slot order."""

    def __init__(self, tree: PerfectHash, prints: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> None:
        self.tree, self.prints, self.counts, self.firsts = tree, prints, counts, firsts
        self.rank = np.cumsum(counts > 1) - 1

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ U64(0xD1B54A32D192ED03)) >> U64(48)).astype("<u2")

    @classmethod
    def build(cls, keys: np.ndarray, holders: np.ndarray, first: np.ndarray) -> LineIndex:
        """Of distinct keys, how many documents hold each, and the smallest of these."""
        tree = PerfectHash.build(keys)
        place = tree.index(keys)
        prints, counts, firsts = np.empty(len(keys), "<u2"), np.empty(len(keys), np.uint8), np.empty(len(keys), "<i8")
        prints[place], counts[place], firsts[place] = cls._print(keys), np.minimum(holders, MOST), first
        return cls(tree, prints, counts, firsts[counts > 1])

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it held by several documents, the first of them or 0) of each key."""
        place = self.tree.index(keys)
        found = place >= 0
        found[found] = self.prints[place[found]] == self._print(keys[found])
        found[found] = self.counts[place[found]] > 1
        first = np.zeros(len(keys), np.int64)
        first[found] = self.firsts[self.rank[place[found]]]
        return found, first


def _batched(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(batch, lines, doc, nameless, many, keys): a row for each Arrow batch, with its documents' distinct key hashes packed."""

    @settled
    def one(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        raw_all, off = flat(batch["text"])
        values, counts = [np.zeros(0, U64)], []
        for a, b in runs(off):
            raw, offsets = raw_all[off[a] : off[b]], off[a : b + 1] - off[a]
            s, e, line_doc = line_spans(raw, offsets)
            k, h = line_keys(raw, offsets, s, e, least)
            d = line_doc[k]
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            fresh = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(d) else np.zeros(0, bool)
            values.append(h[fresh])
            counts.append(np.bincount(d[fresh], minlength=b - a))
        keys = np.concatenate(values)
        columns = [batch["doc"].to_numpy(zero_copy_only=False).astype("<i8"), batch["nameless"].to_numpy(zero_copy_only=False), np.concatenate(counts).astype("<i4"), keys.astype("<u8")]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(keys)]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["batch", "lines", "doc", "nameless", "many", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                yield one(batch, number)
                number += 1

    return _keyed(docs, id_col, text_col).select("doc", "nameless", F.col("_row")[text_col].alias("text")).mapInArrow(pack, "batch bigint, lines bigint, doc binary, nameless binary, many binary, keys binary")


def _of_batch(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, nameless, key) of a packed batch's lines."""
    doc, nameless, many = np.frombuffer(row["doc"], "<i8"), np.frombuffer(row["nameless"], bool), np.frombuffer(row["many"], "<i4")
    return np.repeat(doc, many), np.repeat(nameless, many), np.frombuffer(row["keys"], "<u8")


ASK = "shard bigint, batch bigint, keys binary, first binary, last binary, holders binary"


def _asked(batches: DataFrame, shards: int) -> DataFrame:
    """The distinct keys of each batch by shard, with the smallest and largest document that holds each and how many do."""

    @settled
    def one(row: dict) -> pa.RecordBatch:
        doc, nameless, key = _of_batch(row)
        own, inverse = np.unique(key, return_inverse=True)
        first, last, named = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min), inverse[~nameless]
        np.minimum.at(first, named, doc[~nameless])
        np.maximum.at(last, named, doc[~nameless])
        holders = np.bincount(named, minlength=len(own)).astype("<i8")
        shard = ((own >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)]).tolist()
        spans = list(zip(cut, [*cut, len(own)][1:], strict=True))
        packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (own.astype("<u8"), first, last, holders)]
        return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array([row["batch"]] * len(spans), pa.int64()), *packed], ["shard", "batch", "keys", "first", "last", "holders"])

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                yield one(row)

    return batches.mapInArrow(ask, ASK)


def build_index(asked: DataFrame) -> DataFrame:
    """(shard, tree, prints, counts, firsts): one row for each shard, over all its distinct hashes."""

    @settled
    def build(table: pa.Table) -> pa.Table:
        key, first, last, holders = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", "<u8"), ("first", "<i8"), ("last", "<i8"), ("holders", "<i8")))
        order = np.argsort(key)
        key = key[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first, last, holders = np.minimum.reduceat(first[order], cut), np.maximum.reduceat(last[order], cut), np.add.reduceat(holders[order], cut)
        # rows of equal id are one document
        index = LineIndex.build(key[cut], np.where(first < last, np.maximum(holders, 2), np.minimum(holders, 1)), first)
        return pa.table({"shard": table["shard"][:1], **{n: pa.array([x], pa.binary()) for n, x in (("tree", index.tree.dump()), ("prints", index.prints.tobytes()), ("counts", index.counts.tobytes()), ("firsts", index.firsts.tobytes()))}})

    return asked.groupBy("shard").applyInArrow(lambda t: build(t), "shard bigint, tree binary, prints binary, counts binary, firsts binary")


def _probed(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch, key, first): of each batch, the packed hashes that several documents hold and the first document of each."""

    @settled
    def probe(own: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asks.num_rows:
            tree, prints, counts, firsts = (own[c][0].as_py() for c in ("tree", "prints", "counts", "firsts"))
            lines = LineIndex(PerfectHash.load(tree), np.frombuffer(prints, "<u2"), np.frombuffer(counts, np.uint8), np.frombuffer(firsts, "<i8"))
            for number, packed in zip(asks["batch"].to_pylist(), asks["keys"].to_pylist(), strict=True):
                keys = np.frombuffer(packed, "<u8")
                found, first = lines.probe(keys)
                if found.any():
                    out.append((number, keys[found].tobytes(), first[found].astype("<i8").tobytes()))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("batch", pa.int64()), ("key", pa.binary()), ("first", pa.binary())))})

    return index.groupBy("shard").cogroup(asked.select(F.col("shard").alias("s"), "batch", "keys").groupBy("s")).applyInArrow(lambda a, b: probe(a, b), "batch bigint, key binary, first binary")


def _drops(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc, nameless, drop array<bigint>) of the documents that lose lines."""
    bounded_batches(docs.sparkSession)
    batches = written(_batched(docs, id_col, text_col, least), "lines", compact=True)
    asked = _asked(batches, 1 + (batches.agg(F.sum("lines")).first()[0] or 0) // SHARD_KEYS)
    index = written(build_index(asked), "index")

    @settled
    def resolve(rows: pa.Table, replies: pa.Table) -> pa.Table:
        docs_, nameless_, drops = [], [], []
        if rows.num_rows and replies.num_rows:
            doc, nameless, key = _of_batch(rows.to_pylist()[0])
            known = np.frombuffer(b"".join(replies["key"].to_pylist()), "<u8")
            order = np.argsort(known)
            known, first = known[order], np.frombuffer(b"".join(replies["first"].to_pylist()), "<i8")[order]
            spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
            away = (known[spot] == key) & ((first[spot] != doc) | nameless)
            doc, nameless, key = doc[away], nameless[away], key[away].view(np.int64)
            cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (nameless[1:] != nameless[:-1])][: len(doc)])
            docs_, nameless_, drops = doc[cut], nameless[cut], np.split(key, cut[1:]) if len(cut) else []
        return pa.table({"doc": pa.array(docs_, pa.int64()), "nameless": pa.array(nameless_, pa.bool_()), "drop": pa.array(drops, pa.list_(pa.int64()))})

    found = batches.groupBy("batch").cogroup(_probed(index, asked).select(F.col("batch").alias("b"), "key", "first").groupBy("b")).applyInArrow(lambda a, b: resolve(a, b), "doc bigint, nameless boolean, drop array<bigint>")
    return found.groupBy("doc", "nameless").agg(F.array_distinct(F.flatten(F.collect_list("drop"))).alias("drop"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, doc, nameless); a row without an id goes by its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("doc"), F.col(id_col).isNull().alias("nameless"))


def rebuilt_column(text: Column, drop: Column, least: int) -> Column:
    """struct(n_lines, n_dropped, text) of a text without the lines whose key hash is in drop."""

    @F.arrow_udf("struct<n_lines: bigint, n_dropped: bigint, text: string>")
    @settled
    def rebuilt(texts: pa.Array, drops: pa.Array) -> pa.Array:
        raw_all, off = flat(texts)
        has = drops.is_valid().to_numpy(zero_copy_only=False)
        lines, dropped, out = [], [], []
        for a, b in runs(off):
            raw, offsets = raw_all[off[a] : off[b]], off[a : b + 1] - off[a]
            whole = raw.tobytes()
            count = 1 + np.diff(np.r_[0, np.cumsum(raw == 10)][offsets])
            lines += count.tolist()
            for k in range(b - a):
                lo, hi = int(offsets[k]), int(offsets[k + 1])
                gone = 0
                text = whole[lo:hi]
                if has[a + k]:
                    own, span = raw[lo:hi], np.array([0, hi - lo])
                    s, e, _ = line_spans(own, span)
                    i, h = line_keys(own, span, s, e, least)
                    away = np.zeros(len(s), bool)
                    away[i] = np.isin(h.view(np.int64), np.asarray(drops[a + k].values))
                    gone = int(away.sum())
                    text = b"\n".join(text[x:y] for x, y in zip(s[~away].tolist(), e[~away].tolist(), strict=True))
                dropped.append(gone)
                out.append(text)
        return pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "text"])

    return rebuilt(text, drop)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs, all columns, with the text rebuilt and, unless counts is None, its numbers of lines and of dropped lines.

    A null text becomes an empty one.  Same-named columns of docs are replaced by the counts.
    """
    drops = _drops(docs, id_col, text_col, least)
    joined = _keyed(docs, id_col, text_col).join(drops, ["doc", "nameless"], "left").withColumn("_new", rebuilt_column(F.col("_row")[text_col], F.col("drop"), least))
    kept = [F.col("_new.text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if not counts or c not in counts]
    return joined.select(*kept, *([F.col("_new.n_lines").alias(counts[0]), F.col("_new.n_dropped").alias(counts[1])] if counts else []))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    done = dedup_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def digest_sql(table: str = "documents", least: int = 10) -> str:
    """The same in DuckDB's SQL."""
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}),
    lines AS (SELECT k, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {least} GROUP BY key HAVING min(doc_id) < max(doc_id)),
    marked AS (SELECT k, d.doc_id, i, line, first IS NOT NULL AND d.doc_id IS DISTINCT FROM first AS gone FROM keyed d LEFT JOIN held USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY k
    """
