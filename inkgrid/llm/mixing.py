"""Mixing sources to target weights, native: weighted fair queueing.

Every source gets a target number of words.  Its documents, shuffled by a digest of their ids, stand in a queue that is run
through twice, since no target is above twice the source's size.  A copy's virtual finish time is the number of the source's
words up to its middle, divided by the source's target.  All copies are ranged by that time and taken until the total budget
is reached.

Nothing is sorted in one task: running sums come from the sums of digest ranges of a queue, whose number follows the root of
the number of documents; the cut in the global order is found by range sums of time, narrowing to the range that crosses the
budget until its copies have one time.  Copies of equal time are taken together or not at all.

Defined results: a null text has size 0; a document of size 0 takes 0 words; a null source is a source of its own and comes
last; a source without words has target 0; repeated rows (equal id, size and text) are documents of their own, each with its
own words; an empty table gives no rows; other columns are not read by `plan` and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import text_words, written

#: Ranges of time that are summed at once; so many rows at most reach the driver.
CUTS = 1024
CYCLE = (3, 1, 2)


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, percent: int = 150) -> DataFrame:
    """(source, source_size, target) of a table (source, size): one row for each source.

    Water filling in closed form: by capacity per weight ascending, a source is full if its share of what the fuller ones leave
    is no less than its capacity.  Only sums of each source reach the ordering.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w) for w in cycle])
    weighed = sums.withColumn("w", F.element_at(weights, (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int")).cast("bigint")).withColumn("cap", 2 * F.col("source_size"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    state = weighed.withColumns({"all_size": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "cap_before": F.coalesce(F.sum("cap").over(filled), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(filled), F.lit(0))})
    # in hundredths of words, so that all but the last division is exact
    state = state.withColumn("full", (F.lit(percent) * F.col("all_size") - 100 * F.col("cap_before")).cast("double") * F.col("w") >= (100 * F.col("cap")).cast("double") * (F.col("all_w") - F.col("w_before")))
    state = state.withColumns({"cap_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)), "w_open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(every), F.lit(0))})
    share = (F.lit(percent) * F.col("all_size") - 100 * F.col("cap_full")).cast("double") * F.col("w") / (100 * F.col("w_open")).cast("double")
    return state.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _timed(rows: DataFrame, cycle: tuple[int, ...], percent: int) -> DataFrame:
    """rows (source, size, _d, _v and more; a written table) with source_size, target and the finish times _t1, _t2 of two copies."""
    ranges = 1 << ((max(1, rows.count()).bit_length() + 1) // 2)
    part = (F.conv(F.substring("_d", 1, 15), 16, 10).cast("double") / F.lit(float(1 << 60) / ranges)).cast("int")
    # a source's key: null and "" stay apart, and joins and windows hash the same columns
    rows = rows.withColumns({"_s": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "_r": F.least(part, F.lit(ranges - 1))})
    goals = targets(rows.select("source", "size"), cycle, percent).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"), "source_size", "target")
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_s", "_r").agg(F.sum("size").alias("_block")).withColumn("_before", F.coalesce(F.sum("_block").over(before), F.lit(0))).drop("_block")
    facts = blocks.join(goals, "_s")
    within = Window.partitionBy("_s", "_r").orderBy("_d", "size", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = rows.withColumn("_sum", F.sum("size").over(within)).join(facts, ["_s", "_r"])
    middle = F.col("_before") + F.col("_sum") - F.col("size") / 2
    counts = (F.col("target") > 0) & (F.col("size") > 0)
    return known.withColumns({"_t1": F.when(counts, middle / F.col("target")), "_t2": F.when(counts, (middle + F.col("source_size")) / F.col("target"))}).drop("_s", "_r", "_sum", "_before")


def _cut(timed: DataFrame, percent: int) -> float:
    """The largest finish time up to which all copies together stay within the budget; -1 if none does."""
    total = timed.agg(F.sum("size")).first()[0] or 0
    budget = percent * total  # in hundredths of words
    copies = timed.select("size", F.explode(F.array("_t1", "_t2")).alias("t")).filter(F.col("t").isNotNull())
    low, high, before, best = 0.0, None, 0, -1.0
    part = copies
    while True:
        if high is None:
            found = part.agg(F.min("t"), F.max("t")).first()
            if found[0] is None:
                return best
            low, high = found[0], found[1]
        index = F.least(F.floor((F.col("t") - low) / F.lit((high - low) / CUTS)), F.lit(CUTS - 1)) if high > low else F.lit(0)
        sums = sorted(part.groupBy(index.alias("k")).agg(F.sum("size").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect(), key=lambda r: r["a"])
        for r in sums:
            if 100 * (before + r["n"]) > budget:
                break
            before, best = before + r["n"], r["b"]
        else:
            return best
        if r["a"] == r["b"]:
            return best
        low, high = r["a"], r["b"]
        part = copies.filter(F.col("t").between(low, high))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text.cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_words(text_col).alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), digest)).cast("binary")).alias("_d"), digest.alias("_v"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, cycle: tuple[int, ...], percent: int, seed: str) -> DataFrame:
    rows = written(_rows(docs, id_col, text_col, source_col, seed), "mix", compact=True)
    timed = written(_timed(rows, cycle, percent), "mixed")
    cut = F.lit(_cut(timed, percent))
    return timed.withColumn("taken", F.when(F.col("_t1") <= cut, F.col("size")).otherwise(0) + F.when(F.col("_t2") <= cut, F.col("size")).otherwise(0))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = CYCLE, percent: int = 150, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; taken is 0, size or twice size.

    Texts are read once and never shuffled: short rows are written to the shared folder, shuffled once by (source, range) for
    their finish times, and written again for the search of the cut.
    """
    return _planned(docs, id_col, text_col, source_col, cycle, percent, seed).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = CYCLE, percent: int = 150, seed: str = "mix") -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it (0, 1 or 2 times; rows of no words once).

    Rows meet their plan by the digests of id and text; equal rows share what was planned for them.
    """
    took = F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.col("size")).cast("int")
    copies = _planned(docs, id_col, text_col, source_col, cycle, percent, seed).groupBy("_d", "_v").agg(F.sum(took).alias("_n"), F.count("*").alias("_m"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text.cast("binary"))
    keyed = docs.select(F.struct("*").alias("_row"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), digest)).cast("binary")).alias("_d"), digest.alias("_v"))
    joined = keyed.join(copies, ["_d", "_v"])
    nth = F.row_number().over(Window.partitionBy("_d", "_v").orderBy(F.lit(0)))
    times = F.when(F.col("_m") == 1, F.col("_n")).otherwise(F.floor(F.col("_n") / F.col("_m")) + (F.pmod(F.col("_n"), F.col("_m")) >= F.col("_k")).cast("int")).cast("int")
    return joined.withColumn("_k", nth).withColumn("_c", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")


def plan_sql(cycle: tuple[int, ...] = CYCLE, percent: int = 150, seed: str = "mix", table: str = "documents") -> str:
    """plan() over a table, in DuckDB's SQL."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % " + str(len(cycle)) + "".join(f" WHEN {k} THEN {w}" for k, w in enumerate(cycle)) + " END"
    return f"""
    WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('{seed}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS d, md5(coalesce(text, '')) AS v FROM {table}),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size, {weight} AS w FROM rows GROUP BY source),
    state AS (SELECT *, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w,
        coalesce(sum(2 * source_size) OVER f, 0) AS cap_before, coalesce(sum(w) OVER f, 0) AS w_before
      FROM sums WINDOW f AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    filled AS (SELECT *, ({percent} * all_size - 100 * cap_before)::DOUBLE * w >= (200 * source_size)::DOUBLE * (all_w - w_before) AS is_full FROM state),
    open AS (SELECT *, coalesce(sum(2 * source_size) FILTER (WHERE is_full) OVER (), 0) AS cap_full, coalesce(sum(w) FILTER (WHERE NOT is_full) OVER (), 0) AS w_open FROM filled),
    goals AS (SELECT source, source_size, all_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE
        ELSE ({percent} * all_size - 100 * cap_full)::DOUBLE * w / (100 * w_open)::DOUBLE END AS target FROM open),
    queued AS (SELECT r.*, source_size, all_size, target, row_number() OVER () AS k,
        sum(size) OVER (PARTITION BY r.source ORDER BY d, size, v ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
      FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source),
    copies AS (SELECT k, size, all_size, (middle + turn * source_size) / target AS t FROM queued, (VALUES (0), (1)) turns(turn) WHERE size > 0 AND target > 0),
    ranked AS (SELECT *, sum(size) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS upto FROM copies),
    taken AS (SELECT k, sum(size)::BIGINT AS taken FROM ranked WHERE 100 * upto <= {percent} * all_size GROUP BY k)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN taken USING (k)
    """
