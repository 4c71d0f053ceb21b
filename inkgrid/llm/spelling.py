"""Spelling variants grouped by rolling-hash deletions.

Words are counted where the texts stand and summed by word.  Every word then sends a 64-bit key for each string that it becomes
when one code point is deleted, and one for itself.  A deletion's key is the polynomial hash of the prefix before it plus that of
the suffix after it, shifted by one place, so numpy makes the keys of a batch of words from one running sum.  Keys are dealt by
their leading bits into buckets and sorted there.  Words with one key differ by one replaced code point if it was deleted at the same place,
and by one inserted code point if one of them *is* the shorter string.  Keys that meet no other word end there; the others
fetch their words, and the deleted strings themselves are compared, so a collision of hashes makes no neighbour.

No pair of words is ever formed: within a key and place all words are neighbours of one another, so each takes the size of its
group and the group's two most frequent words.  A key's group is bounded by the alphabet and the length of a word, whatever the corpus.

Defined results: a null text holds no words and an empty table none; in a row with a null id no run is changed; repeated rows count
each; long texts are read in pieces cut between runs, long words make one key for each code point and send no string with
it; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, removed, stored
from ._text import U64, _base_powers, mix

#: The runs, with A-Z already in lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
OTHER = re.compile("[^a-zÀ-ÿ]")
#: Code points of a text that are cut into runs at once.
PIECE = 1 << 20
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 18
#: Keys of a bucket, on average; the number of buckets follows the number of keys.
BUCKET_KEYS = 1 << 17


def text_runs(text: str) -> Counter:
    """How often each run occurs in a lower-cased text."""
    if len(text) <= PIECE:
        return Counter(RUN.findall(text))
    found: Counter = Counter()
    at = 0
    while at < len(text):
        cut = OTHER.search(text, min(at + PIECE, len(text)))
        end = cut.start() if cut else len(text)
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def misspelt(doc_id: str | None, found: Counter, every: int | None) -> Iterator[tuple[str, int]]:
    """(word, count): the runs, without the code point that the crc32 of id and run names where `every` divides that."""
    if doc_id is None or not every:
        yield from found.items()
        return
    begun = zlib.crc32(f"{doc_id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), begun)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = 97) -> DataFrame:
    """(word, n) of all texts; every: see `misspelt`, None leaves the runs as they are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lowered = text.as_py().lower().decode(errors="replace")  # bytes: A-Z only
                for word, n in misspelt(doc_id, text_runs(lowered), every):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield passed()
        if held:
            yield passed()

    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key) of every deletion of one code point, and of each word itself with place -1."""
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words.to_pylist()]
    size = np.array([len(p) for p in points], np.int64)
    end = np.cumsum(size)
    start = end - size
    flat = np.concatenate([*points, np.zeros(0, np.uint32)])
    power, inverse = _base_powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, U64)
    np.cumsum(mix(flat.astype(U64) + U64(1)) * power[: len(flat)], out=total[1:])
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat))
    prefix = (total[at] - total[start[word]]) * inverse[start[word]]
    suffix = (total[end[word]] - total[at + 1]) * inverse[start[word] + 1]
    whole = (total[end] - total[start]) * inverse[start]
    salt = U64(0xD6E8FEB86659FD93)
    cut = mix(prefix + suffix + (size[word] - 1).astype(U64) * salt)
    own = mix(whole + size.astype(U64) * salt)
    return np.r_[word, np.arange(len(size))], np.r_[at - start[word], np.full(len(size), -1)], np.r_[cut, own]


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before, in sorted columns."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _meeting(table: pa.Table) -> pa.Table:
    """Rows of a bucket whose key and place, or whose key and whole word, are met by another word."""
    key, place = table["key"].to_numpy(), table["place"].to_numpy()
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    by_key = np.cumsum(_begins(key)) - 1
    by_both = np.cumsum(_begins(key, place)) - 1
    owns = np.bincount(by_key[place < 0], minlength=by_key[-1] + 1 if len(key) else 0) > 0
    many = np.bincount(by_key) > 1
    same = np.bincount(by_both) > 1
    keep = (same[by_both] & (place >= 0)) | (owns & many)[by_key]
    return table.take(pa.array(np.sort(order[keep])))


def _neighbours(table: pa.Table) -> pa.Table:
    """(id, n_near, best_n, best_id) that the keys of a bucket tell of their words."""
    place, ident, n = (table[c].to_numpy() for c in ("place", "id", "n"))
    left = [w if k < 0 else w[:k] + w[k + 1 :] for w, k in zip(table["word"].to_pylist(), place.tolist(), strict=True)]
    string = pd.factorize(np.array(left, dtype=object))[0]  # the strings themselves decide, not their hashes
    out: list[tuple[np.ndarray, ...]] = []

    # replaced: one string, one place
    row = np.flatnonzero(place >= 0)
    row = row[np.lexsort((ident[row], -n[row], place[row], string[row]))]
    begins = _begins(string[row], place[row])
    group = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    many = np.diff(np.r_[first, len(row)])
    top = first[group]
    best = np.where(top == np.arange(len(row)), np.minimum(top + 1, len(row) - 1), top)
    two = many[group] > 1
    out.append((ident[row][two], (many[group] - 1)[two], n[row][best][two], ident[row][best][two]))

    # inserted: a word that is another's string; doubled letters give a word the same string twice
    whole = np.full(string.max(initial=-1) + 1, -1)
    whole[string[place < 0]] = np.flatnonzero(place < 0)
    row = row[whole[string[row]] >= 0]
    row = row[np.lexsort((ident[row], -n[row], string[row]))]
    row = row[_begins(string[row], ident[row])]
    shorter = whole[string[row]]
    out.append((ident[row], np.ones(len(row), np.int64), n[shorter], ident[shorter]))
    first = np.flatnonzero(_begins(string[row]))
    out.append((ident[shorter[first]], np.diff(np.r_[first, len(row)]), n[row[first]], ident[row[first]]))
    return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["id", "n_near", "best_n", "best_id"])


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the end of each chain, found by joining the links with themselves, twice as far each round."""
    links, path = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved, new_path = stored(links.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        removed(forms.sparkSession, path)
        links, path = moved.select("id", "root"), new_path
        if moved.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, every: int | None = 97, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least least_chars code points and least_n occurrences.

    form is the near word of largest n, ties to the smallest, where that is at least factor times the word's own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = word_counts(docs, id_col, text_col, every).filter((F.char_length("word") >= least_chars) & (F.col("n") >= least_n))
    # ids ascend with the words, so the smaller id is the smaller word
    words, _ = stored(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    keys_ = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    bits = max(0, int(keys_ // BUCKET_KEYS).bit_length())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, place, key = deletion_keys(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(word), PIECE):
                part = slice(a, a + PIECE)
                bucket = (key[part] >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key[part]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key[part].view(np.int64)), pa.array(place[part].astype(np.int64)), pa.array(ids[word[part]])], ["bucket", "key", "place", "id"])

    keys = words.select("id", "word").mapInArrow(keyed, "bucket long, key long, place long, id long")
    meeting, path = stored(keys.groupBy("bucket").applyInArrow(_meeting, keys.schema), "meeting")
    fetched = meeting.select("bucket", "place", "id").join(words.select("id", "word", "n"), "id")
    told = fetched.groupBy("bucket").applyInArrow(_neighbours, "id long, n_near long, best_n long, best_id long")
    near, _ = stored(told.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("other"))).alias("best")).select("id", "n_near", "best.best_n", (-F.col("best.other")).alias("best_id")), "near")
    removed(spark, path)
    forms = words.select("id", "n").join(near, "id").filter(F.col("best_n") >= factor * F.col("n")).select("id", F.col("best_id").alias("form"), F.col("best_n").alias("form_n"))
    roots = _roots(forms)
    names = words.select("id", "word")
    linked = (
        forms.join(roots, "id")
        .join(names.withColumnsRenamed({"id": "form", "word": "form_word"}), "form")
        .join(names.withColumnsRenamed({"id": "root", "word": "root_word"}), "root")
        .select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    )
    found = words.join(near.select("id", "n_near"), "id", "left").join(linked, "id", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def variants_sql() -> str:
    """`variants` of documents with its default parameters, as DuckDB SQL."""
    return """WITH RECURSIVE steps AS (SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
      UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc_table AS (SELECT list(v ORDER BY byte) AS tab FROM steps WHERE k = 8),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    by_doc AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
    bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END)) AS b FROM by_doc),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8)), 4294967295::BIGINT) AS h FROM bytes, crc_table),
    cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    inserted AS (SELECT DISTINCT s.word, s.n, w.word AS other, w.n AS other_n FROM shorter s JOIN words w ON s.part = w.word),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT word, other, other_n FROM inserted UNION ALL SELECT other, word, n FROM inserted),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
    walk AS (SELECT word, word AS root FROM formed WHERE form IS NULL UNION ALL SELECT f.word, k.root FROM formed f JOIN walk k ON f.form = k.word)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word)"""
