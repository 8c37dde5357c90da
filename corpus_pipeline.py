"""From raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.lineage import tidy, written
from graphloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from graphloom.llm.queries import RANK_FILE, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon (learned from the labels that aren't held out) doesn't call toxic."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates."""
    return neardup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, decoded again as a check."""
    return bpe.digests(docs, RANK_FILE)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", remove_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No stage but the last filters by what SQL can express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tidy(spark)
    return docs
