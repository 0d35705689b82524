"""From raw documents to packed training sequences, one operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlens.llm import exact, packing, simhash, suffix, toxicity
from adlens.session import durable


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.drop_passages(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


#: (name, function of (spark, docs, sf_dir)); each stage's rows, stored as Parquet, are the next one's docs.
STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("simhash_near_dedup", _near_dedup),
    ("suffix_array_dedup", _passages),
    ("best_fit_packing", _packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores, fingerprints and bin packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
