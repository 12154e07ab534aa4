"""The corpus pipeline: five stages over `documents`, each calling one operator of `bytelode.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

1. toxicity: documents predicted toxic go; the machine learns from `labels`.
2. quality: documents whose posterior is under one half go.
3. near_duplicates: of each group of near copies the document with the least doc_id stays.
   Rows that share a doc_id but not their text are judged each by its own; rows without a
   doc_id stand for a group only where it has no other.
4. personal_data: spans of personal data are replaced by their kind; no document goes.
5. packing: the remaining documents' token pieces, each with its sequence and offset.

Null text counts as empty text, rows with a null doc_id are judged like any other, and an
empty table gives an empty table in every stage. Labels are read from `sf_dir`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelode.llm import packing, pii, quality, simhash, store, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def quality_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_first(docs)


def personal_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("quality", quality_out), ("near_duplicates", copies_out), ("personal_data", personal_out), ("packing", packed)]

#: SQL cannot express the models, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store.durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
