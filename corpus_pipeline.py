"""Corpus pipeline: the stages that turn raw documents into token ids, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.tables import written

STAGES = [
    ("quality", stages.quality_filter),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontaminated),
    ("secrets", stages.secrets_masked),
    ("token_ids", stages.token_ids),
]

#: SQL cannot express the trained stages and the covering masks; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
