"""The corpus operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crease.llm import bpe, decontam, dialogues, graph, html_text, langid, licenses, periods, pii, quality, secrets, sharding, simhash
from crease.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, where the package public_tokenizers keeps it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op12_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.digest(table(spark, sf_dir, "conversations"), damage=True)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(table(spark, sf_dir, "documents"), damage=True)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_html_text, op3_language, op4_sharding, op5_secrets, op6_pii, op7_decontamination, op8_licenses, op9_simhash, op10_quality, op11_neighbours, op12_dialogues, op13_periods)}
ORACLES = {"op7_decontamination": decontam.ORACLE}
