"""The corpus pipeline: documents pass the stages in turn; each stage's result is written as Parquet and read again.

quality classifier > line dedup > near dedup > personal data > packing. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm import line_dedup, near_dedup, packing, pii, quality
from rasterflow.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier, fitted on labels, rejects."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("good").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of three-line windows out of the texts."""
    return _with_length(line_dedup.dedup_lines(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near duplicates."""
    return near_dedup.without_near_duplicates(docs).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    return _with_length(pii.mask_pii(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row for each piece."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_documents), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_duplicates), ("pii", without_personal_data), ("packing", packed)]

#: SQL can't express the trained stages and the packing; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
