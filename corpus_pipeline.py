"""Cleans `documents` for training: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calltally.llm import stages
from calltally.session import scratch_path

STAGES = [
    ("toxicity", stages.without_toxic),
    ("simhash", stages.without_copies),
    ("decontamination", stages.without_benchmark),
    ("pii", stages.with_pseudonyms),
    ("packing", stages.packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
