"""Stages of the corpus pipeline, one operator each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillgrain.llm import exact_blocks, host_quality, ngram_join, packing, pii_surrogates
from tillgrain.llm.common import unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    kept = host_quality.judge(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts."""
    sha = unused("sha", docs.columns)
    kept = exact_blocks.dedup_exact(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha"))
    keyed = docs.withColumn(sha, F.unhex(F.sha2(F.encode(exact_blocks.normalised(F.col("text")), "utf-8"), 256)))
    same = keyed["doc_id"].eqNullSafe(kept["kept_id"]) & (keyed[sha] == kept["kept_sha"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component: that with the smallest
    doc_id. Documents without an id or without words are in no component and stay."""
    found = ngram_join.join_ngrams(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by surrogates; ``n_chars``, where
    there is one, follows the text."""
    done = pii_surrogates.replace(docs, spark.conf.get(pii_surrogates.KEY_SETTING, "demonstration").encode())
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences as pieces of documents with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("PII surrogates", private), ("packing", packed),
]
