"""Corpus pipeline: five operators applied to ``documents`` one after the other.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, common, decontaminate, jaccard, pii, quality
from tracewright.operators.iterate import remove, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned decision list reject."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of copies and near copies."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, with the digest of the bytes they decode to."""
    return bpe.tokenised(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", tokens),
]

#: Learned rules, LSH and BPE are beyond SQL; tests compare the stages, and the whole, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again, and removed once its successor is written."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}-{name}")
            docs = spark.read.parquet(f"{home}/{k}-{name}")
            if k:
                remove(spark, f"{home}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
