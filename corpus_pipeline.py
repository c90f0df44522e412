"""Corpus pipeline: quality filter, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from soundledger.llm.common import materialize, read
from soundledger.llm.mixing import mixed_documents
from soundledger.llm.packing import pack_documents
from soundledger.llm.quality import kept_documents
from soundledger.llm.simhash import one_of_each_group

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the given labels, predicts to be good."""
    return kept_documents(docs, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

# A trained classifier and a tokenizer decide the rows; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written, and the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
