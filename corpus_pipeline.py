"""A training-data pipeline over the documents table: quality, near-dedup, decontamination, secrets, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crease.llm import bpe, decontam, quality, secrets, simhash
from crease.llm.common import remove, shared_path, table
from crease.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates."""
    return simhash.drop_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.mask(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens."""
    return bpe.digest(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("tokens", tokens_stage),
]

#: SQL can't express byte-pair encoding; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared checkpoint folder and read again.

    Once a stage's table is written, the one it was made from is deleted; the last is left for the result to read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := shared_path(spark, f"pipeline-{uuid.uuid4().hex}"))
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
