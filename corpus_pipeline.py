"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage works on all rows that the stage before it kept; the first four return the columns of documents, the last one
returns packed pieces. The quality classifier and the MinHash bands make the result one that SQL can't express, so it is
tested against a brute-force version (tests/llm/test_passages.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate, minhash, packing, pii, quality
from mnemospark.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the classifier accept."""
    return quality.filter_quality(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars counted anew."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, near_duplicates, decontamination, personal_data, best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        df = stage(f(spark, df, sf_dir), name)
    return df
