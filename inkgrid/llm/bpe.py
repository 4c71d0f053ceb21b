"""Byte-level BPE: texts to token ids and back.

Method: batched numpy merge rounds.  The byte symbols of all words that a batch has not met before lie in one flat array;
in each round every word's lowest-rank adjacent pair is found by binary search over the sorted pair keys, all its
occurrences merge at once, and words without a mergeable pair leave.  Words met before come from a bounded table.  Words of more
than LONG bytes, whose rounds would each rescan them, merge over a linked list instead, with a heap of their pairs.

Defined results: a null text is empty and has no ids; the special tokens of the vocabulary file are found in texts first, as
the file says; rows are independent, so ties, repeated rows and other columns do not matter; texts of any length are taken
whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import bounded_batches
from ._text import flat, ragged, settled

#: Fixed value: the word pattern of byte-level BPE as published for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept between batches of a worker; the table starts anew when it is full.
TABLE = 150_000
#: Texts of these characters alone need no look at newer ones.
OLD = regex.compile("[^\x00-\u052f]")
#: Bytes of a word that still merges in rounds.
LONG = 256
NONE = np.int64(1 << 40)


@lru_cache(maxsize=1)
def _newer() -> regex.Pattern | None:
    """Characters that the pattern's Unicode tables call letters or numbers and the vocabulary's, of Python's age, do not know."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    spans: list[list[int]] = []
    for c in found:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]") if spans else None


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class _Words(dict):
    """Word to row of the table; unknown words get the next row and wait in `fresh`."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k


def tables(spec: str) -> dict:
    """What encoding and decoding need of a vocabulary file's content, as arrays."""
    conf = json.loads(spec)
    vocab: dict[str, int] = conf["model"]["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in conf["model"]["merges"]]
    letters = byte_letters()
    a = np.array([vocab[x] for x, _ in pairs], dtype=np.int64)
    b = np.array([vocab[y] for _, y in pairs], dtype=np.int64)
    keys = (a << 32) | b
    order = np.argsort(keys)
    special = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
    back = {x: k for k, x in enumerate(letters)}
    piece = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for word, k in vocab.items():
        piece[k] = bytes(back[x] for x in word)
    for word, k in special.items():
        piece[k] = word.encode()
    return {
        "of_byte": np.array([vocab[x] for x in letters], dtype=np.int64),
        "keys": keys[order],
        "ranks": np.arange(len(pairs), dtype=np.int64)[order],
        "made": np.array([vocab[x + y] for x, y in pairs], dtype=np.int64),
        "special": special,
        "piece_len": np.array([len(p) for p in piece], dtype=np.int64),
        "pieces": np.frombuffer(b"".join(piece), dtype=np.uint8),
    }


class Bpe:
    """A vocabulary, ready to encode and decode batches."""

    def __init__(self, made_of: dict | str) -> None:
        t = tables(made_of) if isinstance(made_of, str) else made_of
        self.of_byte, self.keys, self.ranks, self.made, self.special = (t[k] for k in ("of_byte", "keys", "ranks", "made", "special"))
        self.piece_len, self.pieces = t["piece_len"], t["pieces"]
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank_of: dict[int, int] = {}
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.ids = np.zeros(0, dtype=np.uint32)
        self.at = np.zeros(0, dtype=np.int64)
        self.len = np.zeros(0, dtype=np.int64)

    def split(self, text: str) -> list[str]:
        newer = OLD.search(text) and _newer()
        if not newer or newer.search(text) is None:
            return self.pattern.findall(text)
        # such characters count as neither letters nor numbers; a sign of that kind stands for each while words are found
        return [text[m.start() : m.end()] for m in self.pattern.finditer(newer.sub("§", text))]

    def merge_long(self, word: str) -> np.ndarray:
        """The ids of one long word: a heap gives the lowest rank, leftmost first; neighbours are linked."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        symbol = self.of_byte[np.frombuffer(word.encode(), np.uint8)].tolist()
        n = len(symbol)
        after, before, rank_of, made = [*range(1, n), -1], list(range(-1, n - 1)), self.rank_of, self.made.tolist()
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if symbol[i] >= 0 else -1
            if j < 0 or rank_of.get(symbol[i] << 32 | symbol[j]) != rank:
                continue  # one of the two has merged since
            symbol[i], symbol[j] = made[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of.get(symbol[i] << 32 | symbol[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of.get(symbol[h] << 32 | symbol[i])) is not None:
                heapq.heappush(heap, (r, h))
        ids = np.array(symbol, np.int64)
        return ids[ids >= 0].astype(np.uint32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, length of each word's ids), by rounds over all words at once."""
        raw, offsets = flat(pa.array(words, pa.large_string()))
        size = np.diff(offsets)
        symbol = self.of_byte[raw]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = np.full(len(symbol), NONE)
            inner = np.flatnonzero(word[:-1] == word[1:])
            key = (symbol[inner] << 32) | symbol[inner + 1]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            pair[inner[hit]] = self.ranks[spot[hit]]
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(pair, begin)
            count = np.diff(np.r_[begin, len(symbol)])
            best_of = np.repeat(best, count)
            rest = best_of < NONE
            if not rest.all():
                done.append((word[~rest], symbol[~rest]))
                symbol, word, pair, best_of = symbol[rest], word[rest], pair[rest], best_of[rest]
            where = np.flatnonzero(pair == best_of)
            if not len(where):
                continue
            # Of overlapping occurrences, as in "aaa", the leftmost merge: every second one of a run of neighbours.
            fresh = np.r_[True, (np.diff(where) != 1) | (word[where[1:]] != word[where[:-1]])]
            head = np.flatnonzero(fresh)
            nth = np.arange(len(where)) - np.repeat(head, np.diff(np.r_[head, len(where)]))
            where = where[nth % 2 == 0]
            symbol[where] = self.made[pair[where]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[where + 1] = False
            symbol, word = symbol[stay], word[stay]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        word, symbol = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat uint32 ids, offsets of the texts)."""
        if len(self.words) > TABLE or len(self.ids) > 8 * TABLE:
            self.clear()
        rows: list[int] = []
        ends = [0]
        look = self.words.__getitem__
        marks: dict[int, int] = {}
        for text in texts:
            if self.cut is not None and any(s in text for s in self.special):
                for k, part in enumerate(self.cut.split(text)):
                    if k % 2:
                        marks[len(rows)] = self.special[part]
                        rows.append(0)
                    elif part:
                        rows.extend(map(look, self.split(part)))
            else:
                rows.extend(map(look, self.split(text)))
            ends.append(len(rows))
        if self.words.fresh:
            fresh, self.words.fresh = self.words.fresh, []
            long = {k: self.merge_long(w) for k, w in enumerate(fresh) if len(w) > LONG // 4 and len(w.encode()) > LONG}
            ids, size = self.merge(["" if k in long else w for k, w in enumerate(fresh)] if long else fresh)
            start = len(self.ids) + np.cumsum(size) - size
            if long:  # behind the others, in the places that the batch's words have
                at = len(self.ids) + len(ids)
                for k, own in long.items():
                    start[k], size[k] = at, len(own)
                    at += len(own)
                ids = np.concatenate([ids, *long.values()])
            self.ids, self.at, self.len = np.concatenate([self.ids, ids]), np.concatenate([self.at, start]), np.concatenate([self.len, size])
        row = np.array(rows, dtype=np.int64)
        ids_at, at, size = self.ids, self.at, self.len
        if marks:  # special tokens stand behind the table
            kinds = np.array(sorted(set(marks.values())), dtype=np.uint32)
            spots = np.fromiter(marks, np.int64, len(marks))
            row[spots] = len(at) + np.searchsorted(kinds, np.fromiter(marks.values(), np.int64, len(marks)))
            at, size, ids_at = np.r_[at, len(ids_at) + np.arange(len(kinds))], np.r_[size, np.ones(len(kinds), np.int64)], np.r_[ids_at, kinds]
        if not len(row):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        length = size[row]
        total = np.r_[0, np.cumsum(length)]
        return ids_at[ragged(at[row], length)], total[np.array(ends)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are not UTF-8 become U+FFFD, ids outside the vocabulary give nothing."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.piece_len))
        safe = np.where(known, ids, 0)
        size = np.where(known, self.piece_len[safe], 0)
        raw = self.pieces[ragged(self.piece_at[safe], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][offsets]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_loaded: dict[int, Bpe] = {}
_numbers = count()


def _bpe(spec) -> Bpe:
    """The task's vocabulary, from a broadcast of its arrays."""
    if spec.id not in _loaded:
        _loaded.clear()
        _loaded[spec.id] = Bpe(pickle.loads(spec.data.value))
    return _loaded[spec.id]


def _each(batches: Iterator[pa.Array], one: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    """one of every batch of a task; the vocabulary and its table of words go with the task, since workers outlive it."""
    try:
        for batch in batches:
            yield one(batch)
    finally:
        _loaded.clear()


@dataclass(frozen=True)
class _Shared:
    id: int
    data: Broadcast


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spec(spark: SparkSession, path: str | None) -> _Shared:
    """The vocabulary file's tables (a few MB, of fixed size), parsed once and broadcast to the workers as arrays."""
    bounded_batches(spark)
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        data = spark.sparkContext.broadcast(pickle.dumps(tables(f.read())))
    return _Shared(next(_numbers), data)


def _chunks(texts: pa.Array, most: int = 500_000):
    """Lists of texts of about `most` code points."""
    part: list[str] = []
    n = 0
    for x in texts:
        t = x.as_py() or ""
        part.append(t)
        n += len(t)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_column(spark: SparkSession, text: Column | str, vocabulary: str | None = None) -> Column:
    """array<int> of a text's token ids."""
    spec = _spec(spark, vocabulary)

    @settled
    def one(texts: pa.Array) -> pa.Array:
        bpe, ids, ends = _bpe(spec), [], [np.zeros(1, np.int64)]
        for part in _chunks(texts):
            i, o = bpe.encode(part)
            ids.append(i)
            ends.append(o[1:] + ends[-1][-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(batches, one)

    return encode(text)


def decode_column(spark: SparkSession, ids: Column | str, vocabulary: str | None = None) -> Column:
    """string of an array of token ids; null is empty."""
    spec = _spec(spark, vocabulary)

    @settled
    def one(rows: pa.Array) -> pa.Array:
        if rows.null_count:
            rows = pa.array([x or [] for x in rows.to_pylist()], pa.list_(pa.int32()))
        offsets = np.asarray(rows.offsets).astype(np.int64)
        values = np.asarray(rows.values.fill_null(-1))[offsets[0] : offsets[-1]]
        return pa.array(_bpe(spec).decode(values, offsets - offsets[0]), pa.string())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(batches, one)

    return decode(ids)


def encode_documents(spark: SparkSession, docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, out_col: str = "token_ids") -> DataFrame:
    """docs with one more column of token ids."""
    return docs.withColumn(out_col, encode_column(spark, F.col(text_col), vocabulary))


def coded_column(spark: SparkSession, text: Column | str, vocabulary: str | None = None, with_ids: bool = True) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256[, token_ids]): digests of the encoder's ids and of what the decoder makes of them."""
    spec = _spec(spark, vocabulary)

    @settled
    def one(texts: pa.Array) -> pa.Array:
        bpe, many, first, second, kept = _bpe(spec), [np.zeros(0, np.int64)], [], [], [np.zeros(0, np.int32)]
        for part in _chunks(texts):
            ids, ends = bpe.encode(part)
            little = ids.astype("<u4").tobytes()
            many.append(np.diff(ends))
            first += [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            second += [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids, ends)]
            if with_ids:
                kept.append(ids.astype(np.int32))
        n = np.concatenate(many)
        columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
        if with_ids:
            columns["token_ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(kept)))
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + (", token_ids: array<int>>" if with_ids else ">"))
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(batches, one)

    return coded(text)


def round_trip(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    One narrow pass over (id, text); no shuffle.
    """
    coded = coded_column(spark, F.col(text_col), vocabulary, with_ids=False)
    return docs.select(F.col(id_col).alias("doc_id"), coded.alias("_d")).select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")
