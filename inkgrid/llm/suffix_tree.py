"""Language-model scoring with a probabilistic suffix tree over words, grown level by level in shards.

The root is the smoothed unigram distribution; a state is a context of the last words.  A word is a candidate if it occurs MIN_SEEN
times; a longer context if it occurs MIN_LONG times, its suffix (one word less at its start) is a state and its prefix (one word
less at its end) was a candidate.
A candidate becomes a state if its next-token distribution diverges from its suffix's by MIN_DIVERGENCE nats or more for each
occurrence and by MIN_GAIN nats over all; these tests alone end the growth (`depth` can end it earlier).  A state keeps the next
tokens that follow it at least MIN_MOVE times: of `seen` occurrences, `c` before token t, and `kinds` kept tokens,
p(t) = (c + kinds q(t)) / (seen + kinds), where q is the suffix's distribution; what is left goes to all other tokens in
proportion to q, so every state sums to one.  A token is scored by the longest suffix of its history that is a state.

Sizes: evidence is counted in occurrences, so the tree grows with the corpus, and no task holds all of it.  Texts become chunks
of CHUNK bytes, stored as numbered words.  For each length of n-grams two exchanges follow.  First a chunk sends its distinct
n-grams to shards by their hash and gets the counts of the corpus back.  Then it sends, once for each context, what its own
occurrences add to the context's divergence; the context's shard adds that up and answers whether it is a state.  A chunk
sends an n-gram or a context once, however often it occurs, so frequent words make no task larger; n-grams that end in too rare
a shorter one, and contexts of several words whose occurrences here leave no room for a kept transition, are not sent.  Tokens whose history
can grow no further leave with their probability, and what is consumed is deleted.

Defined results: a null or empty text is one end token; long texts are read whole; repeated rows are documents of their own, and
count as often as they occur; a row with a null id is held out; without training tokens every probability is that of an
unseen token; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, bucket, removed, stored
from ._text import U64, flat, mix, runs, settled, spans_hash, words

#: Fixed evidence: occurrences of a context and of a kept transition, and nats of divergence, whatever the size of the corpus.
MIN_SEEN = 2
MIN_LONG = 4
MIN_MOVE = 2
MIN_DIVERGENCE = 0.1
MIN_GAIN = 3.0
ALPHA = 0.1
END = int(mix(np.array([0x656E64], dtype=U64)).view(np.int64)[0])
#: Bytes of text in a chunk (a longer document stands with few others), and growing tokens for each shard.
CHUNK, SHARD = 8 << 20, 1 << 20
#: Contexts of two words, the most numerous, go out in so many parts, so that less lies on disks at once.
PARTS = {3: 2}
#: What rows of an exchange hold.
GRAMS, CONTEXTS, COUNTS, STATES, TOKENS, KINDS = range(6)
EXCHANGE = "kind int, dest bigint, chunk bigint, a binary, b binary, n bigint"
STATE = "chunk bigint, active bigint, docs binary, data binary"
SUM = np.dtype([("count", "<u4"), ("kinds", "<f4"), ("lower", "<f4"), ("gain", "<f4")])
ANSWER = np.dtype([("rest", "<f4"), ("kinds", "<f4")])


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, offsets): every document's words and its end."""
    start, end, first = words(raw, offsets)
    h = spans_hash(raw, start, end).view(np.int64)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, a place of each, inverse); sorting need not be stable for that, which is much faster."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]][: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return ranked[fresh], order[fresh], inverse


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of one significance together, which compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T)


def _whole(planes: np.ndarray, kind: str | np.dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows (kind, dest, chunk, a, b, n) of an exchange."""
    names, types = ("kind", "dest", "chunk", "a", "b", "n"), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})


def _cuts(keys: np.ndarray, shards: int) -> tuple[list[int], list[int]]:
    """(shards, their ends) of ascending unsigned keys: a shard holds a range of hashes."""
    own = ((keys >> U64(32)) * U64(shards)) >> U64(32)
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return own[at].tolist(), [*at.tolist(), len(own)]


@dataclass
class Sizes:
    shards: int
    total: int = 0
    kinds: int = 0

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ALPHA) / (self.total + ALPHA * (self.kinds + 1)))


class Chunk:
    """A chunk of documents as numbered words, with the tokens that still grow (`at`), their log p and their context's count.

    parts: vocab (hashes), tok (numbers of words), offsets and held (of documents); then count (of words), known, base and done
    (of documents: known tokens, base score, score of tokens that left), size (of documents), active (bits of tokens), moves (bits
    of growing tokens: may the next n-gram be kept), value and seen (of growing tokens).
    """

    def __init__(self, **parts: np.ndarray) -> None:
        self.parts = parts
        self.vocab, self.tok, self.offsets, self.held = (parts[k] for k in ("vocab", "tok", "offsets", "held"))
        self.docs = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.at = np.flatnonzero(np.unpackbits(parts["active"], count=len(self.tok))) if "active" in parts else np.zeros(0, np.int64)
        self.moves = np.unpackbits(parts["moves"], count=len(self.at)).view(bool) if "moves" in parts else np.zeros(0, bool)

    @classmethod
    def of(cls, texts: pa.Array, held: np.ndarray) -> Chunk:
        h, offsets = tokens(*flat(texts))
        vocab, tok = np.unique(h.view(U64), return_inverse=True)
        # words numbered by falling frequency, whose high bytes compress best
        often = np.argsort(-np.bincount(tok, minlength=len(vocab)), kind="stable")
        number = np.empty(len(vocab), np.int32)
        number[often] = np.arange(len(vocab), dtype=np.int32)
        return cls(vocab=vocab[often], tok=number[tok], offsets=offsets, held=held, size=np.diff(offsets))

    @classmethod
    def load(cls, data: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(data)
        size = int.from_bytes(raw[:4], "little")
        parts, at = {}, 4 + size
        for name, kind, length in json.loads(raw[4:at]):
            parts[name] = _whole(np.frombuffer(raw, np.uint8, length, at), kind)
            at += length
        return cls(**parts)

    def dump(self) -> bytes:
        head = json.dumps([(k, v.dtype.str, v.nbytes) for k, v in self.parts.items()]).encode()
        return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(4, "little"), head, *(_planes(v).tobytes() for v in self.parts.values())]))

    def _hash(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words that end at each place."""
        h = self.vocab[self.tok[at - (n - 1)]]
        for k in range(n - 2, -1, -1):
            h = mix(h * U64(0x9FB21C651E98DF25) + self.vocab[self.tok[at - k]])
        return h

    def _grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct n-grams that end at growing tokens and may be kept, a place of each among these, inverse)."""
        return _distinct(self._hash(self.at[self.moves], n))

    def _now(self, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
        """(log p, count of the context) of the growing tokens."""
        if "value" in self.parts:
            return self.parts["value"].astype(float), self.parts["seen"]
        count = self.parts["count"]
        return sizes.log_base(count)[self.tok[self.at]], count[self.tok[self.at - 1]]

    def asked(self, chunk: int, n: int, sizes: Sizes) -> list[tuple]:
        """Rows to the shards of the chunk's n-grams, with their occurrences in texts that are learnt from."""
        if n == 1:
            order = np.argsort(self.vocab)
            keys, many = self.vocab[order], np.bincount(self.tok[~self.held[self.docs]], minlength=len(self.vocab))[order]
        else:
            keys, _, inverse = self._grams(n)
            many = np.bincount(inverse[~self.held[self.docs[self.at[self.moves]]]], minlength=len(keys))
        shard, cut = _cuts(keys, sizes.shards)
        return [(GRAMS, s, chunk, keys[a:b].tobytes(), _planes(many[a:b].astype("<u4")).tobytes(), None) for s, a, b in zip(shard, cut, cut[1:], strict=False)]

    def words_known(self, count: np.ndarray, sizes: Sizes) -> Chunk:
        """The chunk with its words' counts (in the order asked), before the first contexts."""
        own = np.empty(len(count), np.int64)
        own[np.argsort(self.vocab)] = count
        size, first = np.diff(self.offsets), self.offsets[:-1]
        base, known = sizes.log_base(own)[self.tok], own[self.tok] > 0
        grows = np.zeros(len(self.tok), bool)
        grows[1:] = own[self.tok[:-1]] >= MIN_SEEN
        grows[first[size > 0]] = False
        sums = {"known": np.add.reduceat(known.astype(np.int64), first), "base": np.add.reduceat(base, first), "done": np.add.reduceat(np.where(grows, 0.0, base), first)} if len(first) else {}
        moves = np.packbits(own[self.tok[grows]] >= MIN_MOVE)
        return Chunk(vocab=self.vocab, tok=self.tok, offsets=self.offsets, held=self.held, size=size, count=own, active=np.packbits(grows), moves=moves, **sums)

    def _contexts(self, n: int, total: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, ...]:
        """(contexts ascending, a growing token of each, index of each growing token's, asked: may the context be a state).

        total: the corpus' count of the n-gram at each growing token.
        """
        if n == 2:
            word = self.tok[self.at - 1]
            place = np.full(len(self.vocab), -1, np.int64)
            place[word] = np.arange(len(word))
            some = np.flatnonzero(place >= 0)
            some = some[np.argsort(self.vocab[some])]
            number = np.empty(len(self.vocab), np.int64)
            number[some] = np.arange(len(some))
            return self.vocab[some], place[some], number[word], np.ones(len(some), bool)
        keys, one, of = _distinct(self._hash(self.at - 1, n - 1))
        single = np.bincount(of[(total < MIN_MOVE) & ~self.held[self.docs[self.at]]], minlength=len(keys))
        return keys, one, of, self._now(sizes)[1][one] >= single + MIN_MOVE

    def _totals(self, count: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.at), np.int64)
        out[self.moves] = count[inverse]
        return out

    def summed(self, chunk: int, n: int, part: int, count: np.ndarray, sizes: Sizes) -> list[tuple]:
        """Rows to the shards of a part of the contexts: what this chunk's share of each kept transition adds to its context's sums."""
        keys, place, inverse = self._grams(n)
        context, one, of, asked = self._contexts(n, self._totals(count, inverse), sizes)
        value, seen = self._now(sizes)
        mine = np.bincount(inverse[~self.held[self.docs[self.at[self.moves]]]], minlength=len(keys))
        kept = np.flatnonzero((count >= MIN_MOVE) & (mine > 0))
        at = np.flatnonzero(self.moves)[place[kept]]
        share, q, at = mine[kept] / count[kept], 10.0 ** value[at], of[at]
        sums = np.zeros(len(context), SUM)
        for name, x in (("count", mine[kept]), ("kinds", share), ("lower", share * q), ("gain", mine[kept] * np.log(count[kept] / q))):
            sums[name] = np.bincount(at, weights=x, minlength=len(context))
        asked = np.flatnonzero(asked & (context % U64(PARTS.get(n, 1)) == U64(part)))
        context, sums, seen = context[asked], sums[asked], seen[one][asked]
        some = sums["count"] > 0
        shard, cut = _cuts(context, sizes.shards)
        return [(CONTEXTS, s + part * sizes.shards, chunk, context[a:b].tobytes(), _planes(seen[a:b].astype("<i8")).tobytes() + some[a:b].tobytes() + _planes(sums[a:b][some[a:b]]).tobytes(), None) for s, a, b in zip(shard, cut, cut[1:], strict=False)]

    def grown(self, n: int, count: np.ndarray, state: np.ndarray, sizes: Sizes) -> Chunk:
        """The chunk after the n-grams' counts and the contexts' answers: new log p, and the tokens whose context can grow."""
        _, _, inverse = self._grams(n)
        total = self._totals(count, inverse)
        context, _, of, asked = self._contexts(n, total, sizes)
        answer = np.full(len(asked), np.array((np.nan, 0), ANSWER), ANSWER)
        asked = np.flatnonzero(asked)
        answer[asked[np.argsort(context[asked] % U64(PARTS.get(n, 1)), kind="stable")]] = state
        value, seen = self._now(sizes)
        known = ~np.isnan(answer["rest"])[of]
        other = np.flatnonzero(known & (total < MIN_MOVE))
        value[other] += answer["rest"][of[other]]
        kept = np.flatnonzero(known & (total >= MIN_MOVE))
        kinds = answer["kinds"][of[kept]].astype(float)
        value[kept] = np.log10((total[kept] + kinds * 10.0 ** value[kept]) / (seen[kept] + kinds))
        here = np.zeros(len(self.tok), np.int64)
        here[self.at] = total
        longer = np.where(self.at > 0, here[self.at - 1], 0)
        stays = known & (longer >= MIN_LONG)  # the token before grew too, so no document begins between them
        done = self.parts["done"] + np.bincount(self.docs[self.at[~stays]], weights=value[~stays], minlength=len(self.offsets) - 1)
        active = np.zeros(len(self.tok), bool)
        active[self.at[stays]] = True
        # only the words that longer n-grams need stay
        need = active.copy()
        for k in range(1, n + 1):
            need[:-k] |= active[k:]
        some = np.zeros(len(self.vocab), bool)
        some[self.tok[need]] = True
        used, tok = np.flatnonzero(some), (np.cumsum(some, dtype=np.int32) - np.int32(1))[self.tok[need]]
        offsets = np.r_[0, np.cumsum(np.bincount(self.docs[need], minlength=len(self.offsets) - 1))]
        same = {k: self.parts[k] for k in ("held", "size", "known", "base")}
        return Chunk(vocab=self.vocab[used], tok=tok, offsets=offsets, done=done, active=np.packbits(active[need]), moves=np.packbits(total[stays] >= MIN_MOVE), value=value[stays].astype("<f4"), seen=longer[stays], **same)

    def scores(self, sizes: Sizes) -> np.ndarray:
        if not len(self.at):
            return self.parts["done"]
        return self.parts["done"] + np.bincount(self.docs[self.at], weights=self._now(sizes)[0], minlength=len(self.offsets) - 1)


def _split(table: pa.Table) -> tuple[list[int], list[bytes], list[bytes]]:
    table = table.sort_by("chunk")  # so that sums do not depend on the order of arrival
    return table["chunk"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist()


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where groups of equal keys begin in it, their sizes)."""
    order = np.argsort(keys)
    k = keys[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return order, begin, np.diff(np.r_[begin, len(k)])


def _shared_out(order: np.ndarray, each: np.ndarray, size: np.ndarray, parts: list[int]) -> list[np.ndarray]:
    """A group's value for each of its members, cut into runs of these lengths."""
    out = np.empty(len(order), each.dtype)
    out[order] = np.repeat(each, size)
    return np.split(out, np.cumsum(parts)[:-1])


@settled
def _counted(table: pa.Table) -> pa.Table:
    """A shard of n-grams: their counts for each chunk that asked, and how many tokens and kinds there are."""
    dest, (chunks, a, b) = table["dest"][0].as_py(), _split(table)
    keys, many = np.frombuffer(b"".join(a), "<u8"), np.concatenate([_whole(np.frombuffer(x, np.uint8), "<u4") for x in b])
    order, begin, size = _groups(keys)
    count = np.add.reduceat(many[order].astype(np.int64), begin)
    back = _shared_out(order, count, size, [len(x) // 8 for x in a])
    rows = [(COUNTS, dest, c, _planes(x.astype("<i8")).tobytes(), None, None) for c, x in zip(chunks, back, strict=True)]
    return _rows([*rows, (TOKENS, dest, None, None, None, int(count.sum())), (KINDS, dest, None, None, None, int((count > 0).sum()))])


@settled
def _decided(table: pa.Table) -> pa.Table:
    """A shard of contexts: the log10 share of a state's other tokens (NaN: no state) and its kinds, for each chunk that asked."""
    dest, (chunks, a, b) = table["dest"][0].as_py(), _split(table)
    keys = np.frombuffer(b"".join(a), "<u8")
    seen, sums = np.empty(len(keys), np.int64), np.zeros(len(keys), SUM)
    at = 0
    for x, y in zip(a, b, strict=True):
        n = len(x) // 8
        raw = np.frombuffer(y, np.uint8)
        seen[at : at + n] = _whole(raw[: 8 * n], "<i8")
        sums[at : at + n][raw[8 * n : 9 * n].view(bool)] = _whole(raw[9 * n :], SUM)
        at += n
    order, begin, size = _groups(keys)
    count, kinds, lower, gain = (np.add.reduceat(sums[x][order].astype(float), begin) for x in SUM.names)
    seen, kinds = seen[order[begin]].astype(float), np.round(kinds)
    answer = np.zeros(len(begin), ANSWER)
    answer["rest"] = decide(seen, count, kinds, lower, gain)
    answer["kinds"] = np.where(np.isnan(answer["rest"]), 0, kinds)
    return _rows([(STATES, dest, c, _planes(x).tobytes(), None, None) for c, x in zip(chunks, _shared_out(order, answer, size, [len(x) // 8 for x in a]), strict=True)])


def decide(seen: np.ndarray, count: np.ndarray, kinds: np.ndarray, lower: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """log10 of what the suffix's probabilities of tokens not kept are multiplied by, NaN for contexts that are no states.

    Of kept transitions: count, kinds, lower (their probability by the suffix) and gain (sum of c log(c / q)).
    """
    other_q = np.maximum(1 - lower, 1e-12)
    other_p = np.maximum(seen - count + kinds * other_q, 1e-9 * seen) / np.maximum(seen + kinds, 1e-9)
    left = np.maximum(1 - count / np.maximum(seen, 1), 0)
    divergence = (gain - count * np.log(np.maximum(seen, 1))) / np.maximum(seen, 1) + np.where(left > 0, left * np.log(np.maximum(left, 1e-300) / other_q), 0)
    return np.where((divergence >= MIN_DIVERGENCE) & (divergence * seen >= MIN_GAIN), np.log10(other_p / other_q), np.nan)


def _state(chunk: int, docs: bytes, state: Chunk) -> pa.Table:
    return pa.table([pa.array([chunk]), pa.array([len(state.at) if "active" in state.parts else len(state.vocab)], pa.int64()), pa.array([docs], pa.binary()), pa.array([state.dump()], pa.binary())], ["chunk", "active", "docs", "data"])


def _chunked(rows: DataFrame) -> DataFrame:
    """State rows of the texts of rows (doc_id, held_out, text), in chunks of about CHUNK bytes of text."""

    @settled
    def made(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        chunk = Chunk.of(table["text"], np.asarray(table["held_out"]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select(["doc_id", "held_out"]).schema) as out:
            out.write_table(table.select(["doc_id", "held_out"]))
        return _state(number, sink.getvalue().to_pybytes(), chunk).to_batches()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            off = flat(batch["text"])[1]
            for a, b in runs(off, CHUNK // 4):
                held.append(batch.slice(a, b - a))
                size += int(off[b] - off[a]) + b - a
                if size >= CHUNK:
                    yield made(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield made(held, number)

    return rows.mapInArrow(pack, STATE)


def _asked(state: DataFrame, n: int, sizes: Sizes) -> DataFrame:
    @settled
    def one(number: int, data: bytes) -> pa.Table:
        return _rows(Chunk.load(data).asked(number, n, sizes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch["chunk"], batch["data"], strict=True):
                yield from one(number.as_py(), data.as_py()).to_batches()

    return state.select("chunk", "data").mapInArrow(ask, EXCHANGE)


def _visited(state: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    """f(chunk number, docs, chunk, answers by kind) of every chunk; answers come by shard, in the order of the asked keys."""

    @settled
    def call(mine: pa.Table, others: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[int, bytes]]] = {COUNTS: [], STATES: []}
        for kind, dest, a in zip(*(others[c].to_pylist() for c in ("kind", "dest", "a")), strict=True):
            found[kind].append((dest, a))
        got = {k: np.concatenate([np.zeros(0, t), *(_whole(np.frombuffer(a, np.uint8), t) for _, a in sorted(found[k]))]) for k, t in ((COUNTS, np.dtype("<i8")), (STATES, ANSWER))}
        return f(mine["chunk"][0].as_py(), mine["docs"][0].as_py(), Chunk.load(mine["data"][0].as_py()), got[COUNTS], got[STATES])

    return state.groupBy("chunk").cogroup(answers.select("chunk", "kind", "dest", "a").groupBy("chunk")).applyInArrow(lambda a, b: call(a, b), schema)


def learn(rows: DataFrame, depth: int | None = None) -> tuple[Sizes, DataFrame]:
    """(sizes, state rows with every token's probability) of rows (doc_id, held_out, text); the rest is learnt from."""
    spark = rows.sparkSession
    state, path = stored(_chunked(rows), "chunks", "none")
    total = F.sum("active").alias("n")
    sizes = Sizes(1 + (state.agg(total).first()["n"] or 0) // SHARD)
    n = 1
    while True:
        counts, at = stored(_asked(state, n, sizes).groupBy("dest").applyInArrow(lambda t: _counted(t), EXCHANGE), "counts", "zstd")
        answers, used = counts.filter(F.col("kind") == COUNTS), [at]
        if n == 1:
            sums = {r["kind"]: r["n"] for r in counts.filter(F.col("kind") != COUNTS).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
            sizes = Sizes(sizes.shards, sums.get(TOKENS, 0), sums.get(KINDS, 0))
            new = _visited(state, answers, lambda c, docs, chunk, count, _: _state(c, docs, chunk.words_known(count, sizes)), STATE)
        else:
            found = answers
            for part in range(PARTS.get(n, 1)):
                asked = _visited(state, answers, lambda c, docs, chunk, count, _: _rows(chunk.summed(c, n, part, count, sizes)), EXCHANGE)  # noqa: B023
                states, at = stored(asked.groupBy("dest").applyInArrow(lambda t: _decided(t), EXCHANGE), "states", "zstd")
                found, used = found.unionByName(states), [*used, at]
            answers = found
            new = _visited(state, answers, lambda c, docs, chunk, count, found: _state(c, docs, chunk.grown(n, count, found, sizes)), STATE)
        state, fresh = stored(new, "chunks", "none")
        for old in (path, *used):
            removed(spark, old)
        path, growing = fresh, state.agg(total).first()["n"]
        if n - 1 == depth or not growing:
            return sizes, state
        sizes = Sizes(1 + growing // SHARD, sizes.total, sizes.kinds)
        n += 1


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, depth: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain) of every row.

    gain is (score - base_score) / n_tokens, by which texts that the corpus repeats stand out.  Learns from rows whose crc32(id) mod folds is not held_fold; contexts have at most `depth` words (None: no limit).
    """
    bounded_batches(docs.sparkSession)
    sizes, state = learn(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(bucket(id_col, folds) == held_fold, F.lit(True)).alias("held_out"), F.col(text_col).alias("text")), depth)

    @settled
    def one(docs_: bytes, data: bytes) -> pa.RecordBatch:
        rows, chunk = pa.ipc.open_stream(docs_).read_all(), Chunk.load(data)
        size = len(chunk.offsets) - 1
        columns = [chunk.parts["size"], chunk.parts["known"], np.full(size, sizes.total), chunk.parts["base"], chunk.scores(sizes)]
        return pa.table([rows["doc_id"], rows["held_out"], *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).combine_chunks().to_batches()[0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, data in zip(batch["docs"], batch["data"], strict=True):
                yield one(docs_.as_py(), data.as_py())

    gain = ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return state.select("docs", "data").mapInArrow(scored, schema).select("*", gain)
