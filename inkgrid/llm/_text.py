"""Flat numpy views of Arrow text batches: words, lines and 64-bit hashes without a Python object for each word.

All functions take UTF-8 bytes in one flat array plus document offsets.  White space is space and 0x09-0x0D, as every
operator's contract says, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once; longer documents are hashed in several pieces, so scratch memory does not follow the text length.
PIECE = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def settled(f: Callable) -> Callable:
    """f, which gives freed memory back to the system after each call: idle workers of a pool keep what they held otherwise."""

    @functools.wraps(f)
    def call(*args):
        if pa.default_memory_pool().backend_name != "system":  # whose freed blocks go back at once
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            return f(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return call


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _letters(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with fold, A-Z take the values of a-z."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return table[LOWER] if fold else table


_powers: list[np.ndarray] = []


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them; grown by doubling and kept."""
    base = 0x9E3779B97F4A7C15 | 1
    if not _powers or len(_powers[0]) < n:
        size = max(PIECE, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, dtype=U64)
            p[0], k = 1, 1
            while k < size:
                p[k : 2 * k] = p[:k] * U64(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64) if offs else np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document stands alone."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, side="right")) - 1)
        yield k, min(end, n)
        k = min(end, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document with a final total): words never cross documents."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~WHITE[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[cuts] |= ink[cuts]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] |= ink[last]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each ordered, disjoint span; with fold, A-Z count as a-z.  Equal bytes have equal hashes."""
    letters = _letters(fold)
    out = np.empty(len(starts), dtype=U64)
    k, n = 0, len(starts)
    while k < n:
        low = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        high = int(ends[stop - 1])
        power, inverse = _base_powers(high - low + 1)
        total = np.zeros(high - low + 1, dtype=U64)
        np.cumsum(letters[raw[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[k:stop] - low, ends[k:stop] - low
        out[k:stop] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        k = stop
    return out


def shingles(word_hash: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of n words of each document; a shorter document's whole sequence is one; none gives none."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    total = len(word_hash)
    out_d, out_h = [], []
    if total >= n:
        h = word_hash[: total - n + 1]
        for i in range(1, n):
            h = mix(h * U64(0x9FB21C651E98DF25) + word_hash[i : total - n + 1 + i])
        whole = doc[: total - n + 1] == doc[n - 1 :]
        out_d.append(doc[: total - n + 1][whole])
        out_h.append(h[whole])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h = word_hash[first[short]].copy()
        for i in range(1, n - 1):
            more = count[short] > i
            h[more] = mix(h[more] * U64(0x9FB21C651E98DF25) + word_hash[first[short[more]] + i])
        out_d.append(short)
        out_h.append(mix(h + count[short].astype(U64)))
    if not out_d:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(out_d), np.concatenate(out_h)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at starts, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
