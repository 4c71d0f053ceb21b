"""Change feeds of streams: keyed state that carries rules from page to page, and updates merged into a table by key.

A feed writes each micro-batch's updates below a folder as batch=<number>, and replaces that part if the batch is replayed after a failure;
the table is the last update of each key.  So a run that stops at any moment and starts again gives the table of one
that never stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: The state store that keyed processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CarrySchedule(StatefulProcessor):
    """Marks with the schedule of their document that was met last; one id and its page are the state of a document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.schedule = handle.getValueState("schedule", "id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = self.schedule.get()[0] if self.schedule.exists() else None
        before = now
        # schedules of a page come before its marks
        for row in sorted(rows, key=lambda r: (r.page, r.kind != "schedule", r.id)):
            if row.kind == "schedule":
                now = row.id
            elif now is not None:
                yield Row(doc=key[0], mark_id=row.id, schedule_id=now)
        if now != before:
            self.schedule.update((now,))

    def close(self) -> None:
        pass


def carried(pages: DataFrame) -> DataFrame:
    """(doc, mark_id, schedule_id) of a stream (doc, page, kind "schedule" or "mark", id); pages before a schedule are never filled in later.

    The page is any ordered type; within a batch rows are taken in its order.  Start the stream with `started`, which sets the state store.
    """
    return pages.groupBy("doc").transformWithState(CarrySchedule(), "doc bigint, mark_id bigint, schedule_id bigint", "Update", "None")


def started(stream: DataFrame, folder: str, mode: str = "update", stop_after: int | None = None):
    """Starts a feed over the input at hand; stop_after: fails after that batch is written and before it is committed (for tests)."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")
        if stop_after is not None and number >= stop_after:
            raise RuntimeError("stopped on purpose")

    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(PROVIDER[0], before)


def table(spark: SparkSession, folder: str, schema: StructType, key: str | list[str]) -> DataFrame:
    """The last update of each key of a feed with this schema; without any update an empty table."""
    key = [key] if isinstance(key, str) else key
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/updates")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    updates = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/updates")
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in (*key, "batch")]), "batch").alias("v"))
    return last.select(*key, "v.*")


def fresh_folder(root: str, name: str) -> str:
    return f"{root}/inkgrid-{name}-{uuid.uuid4().hex}"
