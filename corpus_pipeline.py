"""The corpus pipeline: five stages over the documents table, each written as Parquet and reread as the next one's input.

Every stage is one of the operators in seekspark.llm with its production parameters, on all that the
stage before kept. The first four return the columns of documents; the last returns the packing:
(pool, sequence, slot, doc_id, piece, n_tokens, cost).

Defined results, as in the operators' own texts: a null or empty text passes every filtering stage and has no tokens to
pack; null doc_ids stay and are packed; null lang and source are one group; very long texts are read whole; of equal
lines that of the smallest doc_id stays, of near copies the smallest doc_id; rows that repeat doc_id and text
count as one document from line dedup on; columns other than those of documents, whatever their
names, go at the start, and missing ones are null. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekspark.llm import line_dedup, near_duplicates, outliers, packing, pii
from seekspark.llm.common import DOCUMENT_COLUMNS, documents, only, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return outliers.reject_outliers(only(docs, list(DOCUMENT_COLUMNS)))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_deduplication),
    ("pii", private_data),
    ("packing", sequence_packing),
]

#: SQL can't express the outlier estimates, the character model or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
