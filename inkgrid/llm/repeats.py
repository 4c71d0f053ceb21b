"""Periodic runs of words by partition refinement.

Positions of a text stand in classes of equal factors: at length 1 those of equal words.  Position i and j stay together at length
k + 1 if they are together at length k and i + 1 and j + 1 are too, so a class only splits where the positions after it were split in
the step before; of the pieces of a class all but the largest are passed on (the smaller half), which makes n log n moves in all.
Members of a class are linked in the order of positions.  Neighbours at a distance equal to the length are a square; unbroken
stretches of squares of one period are a run, and since the neighbours are nearest, its period is its smallest.

The steps run in numpy over the words of many texts at once, which end at sentinels of their own.  A position's distance only grows, and
is looked at when it changes and at the end, so a length costs what it splits.  Lengths end at a quarter of a text, since a
run holds four periods.

Defined results: a null text has no words, a text of fewer than six words no runs; in a row with a null id no word is changed;
repeated rows have the same result; a long text is refined alone; an empty table gives no rows; of other columns none is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches
from ._text import ragged, settled

#: Words that are refined at once; a longer text stands alone.
WORDS = 1 << 20
#: A run has at least this many words and this many periods.
LEAST, PERIODS = 6, 4


def _after(changed: np.ndarray) -> np.ndarray:
    """True, then changed: where stretches of equal rows begin."""
    out = np.empty(len(changed) + 1, bool)
    out[0] = True
    out[1:] = changed
    return out


def _lengths(begins: np.ndarray, end: int) -> np.ndarray:
    """The lengths of stretches that begin there, the last one up to end."""
    out = np.empty(len(begins), np.int64)
    out[:-1] = begins[1:] - begins[:-1]
    out[-1:] = end - begins[-1:]
    return out


class Classes:
    """Positions in classes: each class is a stretch of `order`, and a list linked by position."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.order = np.argsort(codes, kind="stable")
        sorted_codes = codes[self.order]
        fresh = np.ones(n, bool)
        fresh[1:] = sorted_codes[1:] != sorted_codes[:-1]
        self.of = np.empty(n, np.int64)
        self.of[self.order] = np.cumsum(fresh) - 1
        self.count = int(fresh.sum())
        begins = np.flatnonzero(fresh)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: self.count] = begins
        self.size[: self.count] = _lengths(begins, n)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        a, b = self.order[:-1][~fresh[1:]], self.order[1:][~fresh[1:]]
        self.next[a], self.prev[b] = b, a
        self.marked = np.zeros(n, bool)
        self.since = np.ones(n, np.int64)  # the length from which the distance to the next holds
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(self, at: np.ndarray, length: int) -> None:
        """Notes the squares of positions whose next one is about to change after this length."""
        distance = self.next[at] - at
        found = (distance > 0) & (self.since[at] <= distance) & (distance <= length)
        if found.any():
            self.squares.append((at[found], distance[found]))
        self.since[at] = length + 1

    def move(self, moved: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
        """Makes a class of each group of moved positions, which are sorted by class, group and position; gives the new classes."""
        n = len(self.of)
        old = self.of[moved]
        # unlink: neighbours in the list that move together leave one gap
        by_place = moved[np.argsort(old * n + moved)]
        apart = self.next[by_place[:-1]] != by_place[1:]
        opens = np.flatnonzero(_after(apart))
        closes = opens + _lengths(opens, len(moved)) - 1
        before, after = self.prev[by_place[opens]], self.next[by_place[closes]]
        self.settle(np.concatenate([moved, before[before >= 0]]), length)
        self.next[before[before >= 0]] = after[before >= 0]
        self.prev[after[after >= 0]] = before[after >= 0]
        self.next[moved] = self.prev[moved] = -1
        together = group[1:] == group[:-1]
        a, b = moved[:-1][together], moved[1:][together]
        self.next[a], self.prev[b] = b, a
        # the moved change places with those that stay at the end of the class's stretch
        begins = np.flatnonzero(_after(old[1:] != old[:-1]))
        classes, many = old[begins], _lengths(begins, len(old))
        stays_end = self.start[classes] + self.size[classes] - many
        tail = ragged(stays_end, many)
        there = self.order[tail]
        self.marked[moved] = True
        stays = there[~self.marked[there]]
        self.marked[moved] = False
        holes = self.place[moved]
        holes = holes[holes < np.repeat(stays_end, many)]
        self.order[holes], self.place[stays] = stays, holes
        self.order[tail], self.place[moved] = moved, tail
        firsts = np.flatnonzero(_after(~together))
        new = self.count + np.arange(len(firsts))
        self.start[new], self.size[new] = tail[firsts], _lengths(firsts, len(moved))
        self.size[classes] -= many
        self.of[moved] = np.repeat(new, self.size[new])
        self.count += len(new)
        return new

    def members(self, classes: np.ndarray) -> np.ndarray:
        return self.order[ragged(self.start[classes], self.size[classes])]


def squares(codes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of all squares of primitive root whose period is at most the limit of their position.

    codes name the words of texts one after the other; every text ends with a code that occurs nowhere else.
    """
    n = len(codes)
    classes = Classes(codes)
    active = np.arange(n)
    length, most = 1, int(limit.max(initial=0))
    while length < most and len(active):
        at = active[active > 0] - 1
        at = at[(classes.size[classes.of[at]] > 1) & (limit[at] > length)]
        if not len(at):
            break
        key = classes.of[at] * n + classes.of[at + 1]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        begins = np.flatnonzero(_after(key[1:] != key[:-1]))
        size = _lengths(begins, len(at))
        owner = key[begins] // n
        first_of = _after(owner[1:] != owner[:-1])
        heads = np.flatnonzero(first_of)
        of_class = np.cumsum(first_of) - 1
        rest = (classes.size[owner[heads]] - np.add.reduceat(size, heads))[of_class]
        most_of = np.maximum.reduceat(size, heads)[of_class]
        largest = np.flatnonzero(size == most_of)
        its = of_class[largest]
        largest = largest[_after(its[1:] != its[:-1])]
        is_largest = np.zeros(len(size), bool)
        is_largest[largest] = True
        goes = ~(is_largest & (rest == 0))  # where all were touched, the largest group stays
        if not goes.any():
            break
        group = np.repeat(np.arange(len(size)), size)
        moving = goes[group]
        new = classes.move(at[moving], group[moving], length)
        # the smaller pieces: the new classes, but the old one instead of a new one that is larger
        outgrown = (is_largest & (rest > 0) & (size > rest))[goes]
        active = np.sort(classes.members(np.concatenate([new[~outgrown], owner[goes][outgrown]])))
        length += 1
    distance = classes.next - np.arange(n)
    last = np.flatnonzero((distance > 0) & (classes.since <= distance) & (distance <= limit))
    found = [(at, d) for at, d in classes.squares] + [(last, distance[last])]
    at, period = (np.concatenate(c) for c in zip(*found, strict=True))
    fits = period <= limit[at]
    return at[fits], period[fits]


def merged(at: np.ndarray, period: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period), by start then period, of the runs that squares make."""
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    broken = np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)]
    begins = np.flatnonzero(broken)
    ends = np.r_[begins[1:], len(at)][: len(begins)] - 1
    length = at[ends] - at[begins] + 2 * period[begins]
    fits = length >= np.maximum(least, periods * period[begins])
    out = np.stack([at[begins], length, period[begins]], axis=1)[fits]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def looped(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words, in one of ten documents (by crc32 of the id) periodic from some word on."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def found_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words."""
    codes: list[np.ndarray] = []
    starts, limits, base = [], [], 0
    for words in texts:
        n = len(words)
        seen: dict[bytes, int] = {}
        codes.append(np.fromiter(map(seen.setdefault, words, range(base, base + n)), np.int64, n))
        codes.append(np.array([base + n]))
        starts.append(base)
        limits.append(n // PERIODS if n >= LEAST else 0)
        base += n + 1
    sizes = np.diff(np.r_[starts, base].astype(np.int64))
    limit = np.repeat(np.array(limits, np.int64), sizes)
    rows = merged(*squares(np.concatenate(codes), limit))
    cuts = np.searchsorted(rows[:, 0], np.r_[starts, base])
    return [rows[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those that a run repeats after its first period."""
    if len(runs):
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(cover[:-1]) == 0
        words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
    return b" ".join(words)


def _batches(texts: list[list[bytes]]) -> Iterator[slice]:
    begun, held = 0, 0
    for k, words in enumerate(texts):
        if held and held + len(words) > WORDS:
            yield slice(begun, k)
            begun, held = k, 0
        held += len(words) + 1
    yield slice(begun, len(texts))


def runs_column(text: Column, doc_id: Column | None = None) -> Column:
    """struct<runs: array of (start, length, period), collapsed: string> of a text; with an id its words are `looped` first."""

    @F.arrow_udf("struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    @settled
    def runs(texts: pa.Array, ids: pa.Array) -> pa.Array:
        words = [(t or b"").split() for t in texts.to_pylist()]  # bytes split at space and 0x09-0x0D
        words = [w if i is None else looped(w, i) for w, i in zip(words, ids.to_pylist(), strict=True)]
        rows: list[np.ndarray] = []
        for part in _batches(words):
            if words[part]:
                rows += found_runs(words[part])
        flat = np.concatenate([*rows, np.zeros((0, 3), np.int64)])
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        kept = pa.array([collapsed(w, r) for w, r in zip(words, rows, strict=True)], pa.binary()).view(pa.string())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), each), kept], ["runs", "collapsed"])

    return runs(text.cast("binary"), F.lit(None).cast("string") if doc_id is None else doc_id.cast("string"))


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed) of every row; loops: see `looped`.  No shuffle."""
    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), runs_column(F.col(text_col), F.col(id_col) if loops else None).alias("r"))
    return found.select("doc_id", "r.runs", "r.collapsed")


def digest(docs: DataFrame) -> DataFrame:
    """`periodic` of looped texts as counts, the run of most periods, and digests of all runs and of the collapsed text."""
    def order(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        return F.signum(F.when(more != 0, more).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])).cast("int")

    most = F.array_sort("runs", order)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.get(most, F.lit(0))
    return periodic(docs, loops=True).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Lengths that the SQL compares, in powers of two: enough for texts of fewer than 2**(SQL_LEVELS + 2) words.
SQL_LEVELS = 14


def digest_sql() -> str:
    """`digest` of documents as DuckDB SQL.

    Factors of length g = 1, 2, 4, ... get ranks by doubling.  Within a run of smallest period q, with q <= g < 2q, the next occurrence of
    the factor at a position is q further on, so unbroken stretches of that distance are the runs.
    """
    levels = ["rank0 AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY w) AS r FROM word)"]
    for k in range(1, SQL_LEVELS):
        g = 1 << (k - 1)
        levels.append(f"rank{k} AS (SELECT a.doc_id, a.i, dense_rank() OVER (ORDER BY a.r, b.r) AS r FROM rank{k - 1} a JOIN rank{k - 1} b ON a.doc_id = b.doc_id AND b.i = a.i + {g})")
    nexts = " UNION ALL ".join(f"SELECT doc_id, i, d, {1 << k} AS g FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, r ORDER BY i) - i AS d FROM rank{k}) t WHERE d <= {1 << k} AND 2 * d > {1 << k}" for k in range(SQL_LEVELS))
    return f"""WITH RECURSIVE steps AS (SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
      UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc_table AS (SELECT list(v ORDER BY byte) AS tab FROM steps WHERE k = 8),
    split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT) AS bytes FROM documents),
    hashed AS (SELECT doc_id, words, len(words) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8)), 4294967295::BIGINT) AS h FROM split, crc_table),
    planned AS (SELECT *, h % 10 = 0 AND n > 0 AS loops, CASE WHEN n > 0 THEN h // 10 % n ELSE 0 END AS a, h // 10 % 8 AS e FROM hashed),
    word AS MATERIALIZED (SELECT doc_id, i, words[1 + CASE WHEN loops AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + e)) ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM planned) p),
    {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in levels)},
    near AS ({nexts}),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM near),
    run AS MATERIALIZED (SELECT doc_id, min(i) AS start, max(i) - min(i) + d + any_value(g) AS length, d AS period FROM islands GROUP BY doc_id, d, island HAVING max(i) - min(i) + d + any_value(g) >= greatest({LEAST}, {PERIODS} * d)),
    told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM run) r WHERE k = 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    kept AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS text FROM word w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start, top.length, top.period, 1000 * top.length // top.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""
