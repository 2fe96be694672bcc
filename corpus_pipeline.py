"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Every stage takes rows with null, empty and repeated texts and ids, and other columns of any name, as its operator's docstring
says; an empty table goes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import dart_minhash, decision_lists, packing, pii
from tallyspark.llm.queries import VOCABULARY, table
from tallyspark.plans.staging import discard, discard_unread, new_path, shuffles_freed, watched

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By application, what the stages before have settled inside and nothing was seen to be done with.
_LEFT: dict[str, list[str]] = {}


def freeing(stage: Stage) -> Stage:
    """A stage whose input was written by then: what the stages before settled inside and the input does not read is deleted first."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = discard_unread(spark, _LEFT.pop(spark.sparkContext.applicationId, []), docs)
        with watched() as settled:
            out = stage(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = left + settled
        return out
    return run_stage


@freeing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list let pass; a null or empty text fails the base rules."""
    return decision_lists.kept_documents(docs, table(spark, sf_dir, "labels"))


@freeing
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id; unrelated texts under one id stay each."""
    return dart_minhash.without_near_duplicates(docs)


@freeing
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; null texts stay null."""
    return pii.redacted(docs)


@freeing
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in pieces, each with its sequence and its place there; a null or empty text is the end id alone."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("personal data", personal_data), ("packing", pack)]
#: Learned rules, signatures and token ids are beyond SQL; tests/llm/test_pipeline.py holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage is written and read by the next, and gone when that is written."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with shuffles_freed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(before)  # the given table is none of this session's stages, so it stays
        before = docs
    return docs
