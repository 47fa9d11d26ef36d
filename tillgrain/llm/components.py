"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillgrain.llm.common import settled


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array(
        F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b; integers): label is the
    smallest node it can reach. Every step is written as a table, so lost
    executors cost one step; only its size and checksum come to the driver.
    """
    tidy = lambda e: e.where("a <> b").distinct()
    current = settled(tidy(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))), name)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = None
    while (now := mark(current)) != seen:
        seen = now
        current = settled(tidy(_small_star(tidy(_large_star(current)))), name)
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(current.select("b", "b").distinct())
