"""A corpus pipeline over ``documents``: language, quality, exact copies, near copies, packing.

Each stage works on all that its predecessor kept and is written to the shared folder before the next one reads it. Stages
decide about rows, whatever their doc_id: rows that repeat a doc_id, or have none, are judged by their own text. Null texts
are empty: language ID rejects them. Empty tables go through. Columns of documents are kept as they are."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import exact_dedup, language_id, packing, rule_ensemble, simhash
from vecspark.llm.common import scratch, shared_dir, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language_id.keep_identified(docs)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return rule_ensemble.keep_accepted(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then that with the smallest doc_id (null first), then the first."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that with the smallest doc_id (null last), then the first."""
    return simhash.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("quality_classifier", of_quality),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with scratch(spark):  # a stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The stages learn and hash in ways that SQL can't say.
ORACLE_SQL = None
