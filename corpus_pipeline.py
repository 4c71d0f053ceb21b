"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.

Defined results of all stages: an empty table gives no rows; null and empty texts, null ids and repeated rows are what the
operator of the stage says of them (a null text leaves line dedup as an empty one); other columns go along unread, whatever their
names; texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import bpe, line_dedup, mixing, near_dedup, quality_model
from inkgrid.llm._tables import written

#: A classifier and shuffled digests decide here, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a document of smaller id holds; n_chars follows the new text."""
    return line_dedup.dedup_lines(docs, counts=None).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id."""
    return near_dedup.keep_first(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, token_ids) of every row."""
    return docs.select("doc_id", "lang", "source", bpe.coded_column(spark, F.col("text")).alias("_c")).select("doc_id", "lang", "source", "_c.*")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing sources", mix), ("BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
