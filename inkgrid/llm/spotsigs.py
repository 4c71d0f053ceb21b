"""Document fingerprints by spot signatures.

A spot is a common word (an anchor, or the beginning of the text); its signature is a short hash of the anchor and the chain of the next content
words, other anchors skipped.  Content that replaces common words, or moves as a whole, keeps most signatures; boilerplate of bare names and links
has few anchors and so few of them.  A fingerprint is the sorted set of a text's signatures, eight hexadecimal digits each.

Two fingerprints are as alike as the Jaccard index of their sets.  Sets of a likeness of at least t have sizes within a factor of t, so
sets belong to classes of size, each a factor of t wide, and only sets of one or of neighbouring classes within that factor are
compared at all; equal fingerprints need no comparison either.

Everything is native: no Python runs on executors.  A document finds the next one in descending order of ids without one window over
all of them: ids are cut at approximate quantiles into as many buckets as there are shuffle partitions, and the first document of
each bucket also goes to the bucket before it.  The texts are shuffled once.

Defined results: a null text is an empty one; a text without a chain (fewer than two content words) has one signature, that of the
whole text, so equal texts have equal fingerprints always; null ids come last, rows of equal ids in the order of their texts' hashes; a table of
one row is its own next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, Spanish and French; the empty one is the beginning of a text.
ANCHORS = (
    "",
    *"a an and are as at be but by for from has have he in is it its not of on or she that the their there they this to was we were which will with you".split(),
    *"aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie sind und von war wie wird zu".split(),
    *"como con de del el en es la las lo los más mi no para pero por que se su un una y".split(),
    *"au aux ce dans des elle et il je le les mais ne nous ou par pas plus pour qui sur une vous".split(),
)
WORD = "[\\p{L}\\p{N}]+"
#: Content words of a chain.
CHAIN = 2
#: Hexadecimal digits of a signature.
DIGITS = 8


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _short(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, DIGITS)


def signatures(text: Column, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The sorted set of the signatures of a text that is not null."""

    def anchored(w: Column) -> Column:
        return w.isin(*anchors)

    def of_words(words: Column) -> Column:
        spots = F.filter(F.transform(words, lambda w, i: F.when(anchored(w), i)), lambda i: i.isNotNull())
        return _let(F.struct(words.alias("words"), F.filter(words, lambda w: ~anchored(w)).alias("content"), spots.alias("spots")), chains)

    def chains(s: Column) -> Column:
        # the k-th anchor, at word i, has i - k content words before it
        whole = F.filter(F.transform(s["spots"], lambda i, k: F.struct(i.alias("i"), (i - k).alias("c"))), lambda p: p["c"] + chain <= F.size(s["content"]))
        return F.transform(whole, lambda p: _short(F.concat_ws(" ", F.get(s["words"], p["i"]), *[F.get(s["content"], p["c"] + j) for j in range(chain)])))

    found = _let(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), of_words)
    return F.array_sort(F.array_distinct(_let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(_short(text))))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "")


def signature_set(print_: Column) -> Column:
    """The signatures of a fingerprint."""
    return F.regexp_extract_all(print_, F.lit(".{%d}" % DIGITS), F.lit(0))


def size_class(n: Column, least: float) -> Column:
    """Classes of set sizes, each a factor of `least` wide: sets at least so alike lie in one class or in neighbouring ones."""
    return F.floor(F.ln(n.cast("double")) / -math.log(least)).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard index of two fingerprints; 0 if it cannot reach `least`, by size class and sizes alone, before any set is looked at."""

    def of_sizes(s: Column) -> Column:
        small, large = F.least(s["a"], s["b"]), F.greatest(s["a"], s["b"])
        far = F.lit(False) if least <= 0 else (F.abs(size_class(s["a"], least) - size_class(s["b"], least)) > 1) | (small < least * large)
        return F.when(a == b, 1.0).when(far, 0.0).otherwise(_let(F.size(F.array_intersect(signature_set(a), signature_set(b))), lambda n: n / (s["a"] + s["b"] - n)))

    return _let(F.struct((F.length(a) / DIGITS).alias("a"), (F.length(b) / DIGITS).alias("b")), of_sizes)


def _bucket(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most value, by a binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= bounds[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(bounds))


def with_next(docs: DataFrame, id_col: str, key: str, columns: list[str]) -> DataFrame:
    """docs with next_<c> for each of the columns: its value in the next row, descending by id and key; after the last row comes the first.

    The driver holds the ids that cut the buckets and the first row's id and key of each, as many as shuffle partitions.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    bounds = sorted(set(cuts or []))
    # null ids: a bucket below all others
    bucketed = docs.withColumn("_bucket", F.when(F.col(id_col).isNull(), -1).otherwise(_bucket(F.col(id_col), bounds)))
    firsts = sorted(bucketed.groupBy("_bucket").agg(F.max(F.struct(id_col, key)).alias("first")).collect(), key=lambda r: -r["_bucket"])
    if not firsts:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    kind = docs.schema
    before = F.array(*[F.struct(F.lit(r["_bucket"]).alias("_bucket"), F.lit(r["first"][0]).cast(kind[id_col].dataType).alias("_first"), F.lit(r["first"][1]).cast(kind[key].dataType).alias("_key"), F.lit(firsts[k - 1]["_bucket"]).alias("_before")) for k, r in enumerate(firsts)])
    heads = docs.sparkSession.range(1).select(F.explode(before).alias("h")).select("h.*")
    is_first = F.col(id_col).eqNullSafe(F.col("_first")) & F.col(key).eqNullSafe(F.col("_key"))
    to = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("ahead")))
    sent = bucketed.join(F.broadcast(heads), "_bucket").withColumn("_to", F.explode(F.when(is_first, F.concat(to, F.array(F.struct(F.col("_before").alias("b"), F.lit(True).alias("ahead"))))).otherwise(to)))
    sent = sent.select(*docs.columns, "_to.b", "_to.ahead")
    order = Window.partitionBy("b").orderBy("ahead", F.col(id_col).desc_nulls_last(), F.col(key).desc_nulls_last())
    return sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter(~F.col("ahead")).drop("b", "ahead")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, text_hash, fingerprint) of every row, empty text for null."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.withColumn("text_hash", F.xxhash64("text")).withColumn("fingerprint", fingerprint(signatures(F.col("text"))))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text ends, instead of in its last third, in as much of the next document's beginning.
    """
    paired = with_next(fingerprints(docs, id_col, text_col), "doc_id", "text_hash", ["text", "fingerprint"])
    n = F.length("text").cast("bigint")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - third), F.substring("next_text", F.lit(1), third))
    made = paired.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(signatures(F.col("edited"))).alias("edited_fingerprint"))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def compare_edited_sql() -> str:
    """`compare_edited` of documents as DuckDB SQL."""
    anchors = ", ".join(f"'{a}'" for a in ANCHORS)
    chain = " || ' ' || ".join(["words[p]", *[f"content[p - k + {j + 1}]" for j in range(CHAIN)]])
    alike = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
    e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited FROM n),
    texts AS (SELECT text FROM d UNION SELECT edited FROM e),
    split AS (SELECT text, list_prepend('', regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS words FROM texts),
    parts AS (SELECT text, words, list_filter(words, lambda w: w NOT IN ({anchors})) AS content, list_filter(range(1, len(words) + 1), lambda i: words[i] IN ({anchors})) AS spots FROM split),
    chains AS (SELECT text, list_filter(list_transform(spots, lambda p, k: {chain}), lambda c: c IS NOT NULL) AS chains FROM parts),
    sets AS (SELECT text, list_sort(list_distinct(list_transform(CASE WHEN len(chains) > 0 THEN chains ELSE [text] END, lambda c: md5(c)[1:{DIGITS}]))) AS sigs FROM chains)
    SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a.sigs, '') AS fingerprint, array_to_string(b.sigs, '') AS edited_fingerprint,
      {alike.format(a='a.sigs', b='b.sigs')} AS near_edited, {alike.format(a='a.sigs', b='c.sigs')} AS near_next
    FROM e JOIN sets a ON e.text = a.text JOIN sets b ON e.edited = b.text JOIN sets c ON e.next_text = c.text"""
