"""The training-data pipeline over ``documents``: quality, toxicity, exact and near dedup, packing.

Every stage takes null ids and texts (a null text is empty), rows repeated whole or by id, very long texts, columns of any name beside its
own, and an empty table, which stays empty. All but the last return rows of ``documents`` as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import shared
from tracelake.llm.exact_dedup import drop_copies
from tracelake.llm.packing import pack
from tracelake.llm.quality import drop_low_quality
from tracelake.llm.simhash import drop_near_copies
from tracelake.llm.toxicity import drop_toxic


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the log-likelihood ratio keep; null and empty texts fail the base rules. Each row is decided by its own text."""
    return drop_low_quality(docs, _labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; each row by its own text, null and empty ones by the model's bias."""
    return drop_toxic(docs, _labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest id (null last), then the first of repeated rows."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; the smallest id stays, null last. Texts without a shingle are one group."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, in sequences of 2048 tokens; a null or empty text is one piece, the end id alone."""
    return pack(docs)


STAGES: list = [("quality rules", quality_rules), ("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("packing", packing)]
#: A trained classifier and the tokenizer cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
