"""The corpus pipeline: stages over documents, each written and read again.

Toxic documents go, one document of each near-duplicate group stays, documents
contaminated by the benchmark go and stray benchmark spans are cut from the
others, personal data get surrogates, and the rest is mixed to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import _shared, decontamination, minhash_dedup, mixing, pii, toxicity


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", filter_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", replace_pii),
    ("mixing", mix_sources),
]

#: Trained and fuzzy stages have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole documents table, each result a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _shared.kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
