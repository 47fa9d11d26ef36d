"""Corpus preparation: quality rules, exact dedup, n-gram Jaccard join, PII surrogates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillgrain.llm.common import settled
from tillgrain.llm.stages import STAGES

#: Near-duplicate components, surrogates and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is a table before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
