"""Structured Streaming: the state of each document's progress, and rules carried from page to page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.summary import latest


def progress_events(pages: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """(pdf_id, seq, curr_step, total_steps, msg, success): a start with pages + 1 steps, one event for each page, a done."""
    total = pages.groupBy(F.col(doc).alias("pdf_id")).agg((F.count_distinct(page) + 1).alias("total_steps"), F.max(page).alias("last"))
    start = total.select("pdf_id", F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("curr_step"), "total_steps", F.lit("start").alias("msg"), F.lit(None).cast("boolean").alias("success"))
    step = F.col("nth").cast("bigint")
    from pyspark.sql import Window

    ranked = pages.select(F.col(doc).alias("pdf_id"), F.col(page)).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("pdf_id").orderBy(page)))
    each = ranked.select("pdf_id", step.alias("seq"), step.alias("curr_step"), F.lit(None).cast("bigint").alias("total_steps"), F.lit("page").alias("msg"), F.lit(None).cast("boolean").alias("success"))
    done = total.select("pdf_id", F.col("total_steps").alias("seq"), F.lit(None).cast("bigint").alias("curr_step"), F.lit(None).cast("bigint").alias("total_steps"), F.lit("done").alias("msg"), F.lit(True).alias("success"))
    return start.unionByName(each).unionByName(done)


def latest_progress(events: DataFrame, key: str = "pdf_id", columns: tuple[str, ...] = ("curr_step", "msg", "success")) -> DataFrame:
    """Update-mode change feed: the same aggregation as in a batch, kept as state of a stream."""
    return latest(events, key, columns)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows; later than `delay` behind the watermark they are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def carry_schedules(pages: DataFrame) -> DataFrame:
    """(doc, page, mark_id, schedule_id): marks with the latest schedule met so far in their document's stream.

    pages (doc, page, kind "schedule" or "mark", id).  Pages before a schedule are never filled in later.  State is one id for
    each document.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["page", "kind", "id"], ascending=[True, False, True], kind="stable")
        out = []
        for row in rows.itertuples():
            if row.kind == "schedule":
                now = int(row.id)
            elif now is not None:
                out.append((key[0], row.page, row.id, now))
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=["doc", "page", "mark_id", "schedule_id"])

    return pages.groupBy("doc").applyInPandasWithState(step, "doc bigint, page bigint, mark_id bigint, schedule_id bigint", "schedule_id bigint", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands every micro-batch to a sink; available input is processed, then it ends."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
