"""Ranking and exact medians inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tillgrain.session import through_table

def ranked(df: DataFrame, keys: list[str], value: str, tie: str, name: str = "place") -> DataFrame:
    """Row number by ``value`` descending, then ``tie`` ascending, per group.

    A plain window would sort all of a hot group in one task, and so would bands
    of values where a million rows share one. Here the rows are dealt into ranges
    of (group, value, tie) of about equal size, which split equal values by their
    tie; a row's number inside its range is known where the range is sorted and
    written, and the sizes of the ranges before are added. So rows are exchanged
    once, whatever they hold; the table of sizes has a row per range and group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, F.col("_value"), F.col(tie)]
    dealt = df.withColumn("_value", -F.col(value)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id of a row counts the rows of its partition in the lower 33 bits
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = through_table(dealt.withColumns({"_range": F.spark_partition_id(), "_at": number}), "ranked")
    sizes = stored.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_before"))
    return (
        stored.join(through_table(offsets, "ranges"), [*keys, "_range"])
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_range", "_value", "_before", "_at")
    )


def median(df: DataFrame, keys: list[str], value: str, tie: str, name: str) -> DataFrame:
    """Exact median per group from the one or two middle ranks. The built-in
    ``median`` keeps every distinct value of a group in one task's memory.
    ``df`` must be a stored table: it is read twice. NULLs do not count."""
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_size"))
    middle = F.col("_place").isin(F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1)
    return (
        ranked(df.filter(F.col(value).isNotNull()), keys, value, tie, "_place")
        .join(sizes, keys)
        .filter(middle)
        .groupBy(*keys)
        .agg(((F.min(value) + F.max(value)) / 2).alias(name))
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """First ``k`` rows per group. Spark cuts each input partition to ``k`` rows
    per group before the shuffle (window group limit), so hot groups are cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
