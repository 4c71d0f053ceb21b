"""Intermediate tables in the shared folder of the cluster, and the deterministic keys that operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used in local mode where the session names no checkpoint folder, as in tests.
FALLBACK = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; on a cluster it must be named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return FALLBACK


#: Rows of a batch that workers exchange with the JVM; texts are long, and both sides hold a batch and its result.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows for each Arrow batch to BATCH_ROWS, unless it asks for fewer; Spark bounds the bytes besides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """(df, computed once, written as Parquet below the shared checkpoint folder and read again; the table's path).

    Cuts the lineage in a way that survives lost executors and avoids computing a branch twice.  The schema is handed to the
    reader, so an empty result keeps its columns.  What the query shuffled is deleted with its end, since nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkgrid-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """`stored`, for tables that a lazy result still reads; compact: the many small parts of a scan's result become few of the advisory size."""
    return stored(df.hint("rebalance") if compact else df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def text_words(text: Column | str) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null counts as none (native)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def bucket(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))
