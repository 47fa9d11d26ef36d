"""Raw point-of-sale exports: header resolution and the file scan."""

from __future__ import annotations

import csv
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Accepted headers per logical field, first match wins.
ALIASES = {
    "order_reference": ("order_reference", "order_id", "order_ref", "Order ID"),
    "sku": ("sku", "SKU", "product_sku"),
    "quantity": ("quantity", "qty", "Quantity"),
    "unit_price": ("unit_price", "price", "Unit Price"),
    "unit_cost": ("unit_cost", "cost", "Unit Cost"),
    "category_en": ("categ_EN", "category_en", "category", "Category"),
    "category_ar": ("categ_AR", "category_ar"),
    "name_en": ("name", "name_en", "product_name", "Product"),
    "name_ar": ("name_localized", "name_ar", "arabic_name"),
    "customer_name": ("customer_name", "customer", "Customer"),
    "season": ("season", "Season"),
    "occasion": ("occasion", "Occasion"),
    "time_period": ("time_period", "timePeriod", "time_zone"),
    "date": ("date", "Date", "order_date"),
    "time": ("time", "Time", "order_time"),
    "datetime": ("created_at", "order_datetime", "datetime"),
}
REQUIRED = ("order_reference", "quantity", "unit_price", "unit_cost", "category_en")
CARRIED = ("user_id", "is_imputed")


class ContractError(ValueError):
    """A file without the required columns."""

    def __init__(self, missing: list[str], found: list[str]):
        super().__init__(f"missing required columns {missing}; found {found}")
        self.missing, self.found = missing, found


def resolve(raw: DataFrame) -> DataFrame:
    """Trim headers and project them to the logical fields that are present."""
    headers = {c.strip(): c for c in raw.columns}
    chosen = {
        field: next((headers[a] for a in names if a in headers), None) for field, names in ALIASES.items()
    }
    missing = [f for f in REQUIRED if chosen[f] is None]
    if missing:
        raise ContractError(missing, list(headers))
    if chosen["date"] is None and chosen["datetime"] is None:
        raise ContractError(["date or datetime"], list(headers))
    kept: list[Column] = [F.col(f"`{c}`").alias(f) for f, c in chosen.items() if c is not None]
    kept += [F.col(headers[c]).alias(c) for c in CARRIED if c in headers]
    return raw.select(*kept)


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below ``path`` by their header line. One job looks at all files: the
    first line of a file's first split is its header. Empty files have none."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("line"))
    first = lines.filter("at = 0").groupBy("file").agg(F.min("line").alias("line"))
    found: dict[str, list[str]] = {}
    for row in lines.join(first, ["file", "line"]).select("file", "value").orderBy("file").collect():  # a row for each file
        found.setdefault(row["value"].lstrip("\ufeff"), []).append(row["file"])
    return found


def scan(spark: SparkSession, header: str, files: list[str]) -> DataFrame:
    """Files of one header as text columns; a line with another number of cells
    is kept in ``malformed_line``, with the others NULL."""
    columns = next(csv.reader([header]))
    fields = [T.StructField(c, T.StringType()) for c in [*columns, "malformed_line"]]
    return (
        spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "malformed_line").csv(files)
    )


def _filled(rows: DataFrame) -> Column:
    """Lines with any cell. Spark reads no file for its malformed lines alone, and
    checks the number of cells only where it is asked for cells."""
    return F.coalesce(*[F.col(f"`{c}`") for c in rows.columns]).isNotNull()


def read_csv(spark: SparkSession, path: str, each: Callable[[DataFrame], DataFrame] = lambda fields: fields) -> DataFrame:
    """All files below ``path``, columns as text; typing belongs to the cleaning
    step. Files are grouped by their header and each group is scanned with its
    own, so column order and names may differ. ``each`` runs on every group before
    they meet: fallbacks depend on the columns a file has. Malformed and blank
    lines are left out; ``malformed`` counts the former."""
    def kept(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("malformed_line").isNull() & _filled(rows.drop("malformed_line"))).drop("malformed_line")

    parts = [each(resolve(kept(scan(spark, h, files)))) for h, files in headers(spark, path).items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, malformed): lines with any cell of every file, and how many were left out."""
    counted = lambda rows: rows.groupBy(F.input_file_name().alias("file")).agg(
        F.count_if(_filled(rows)).alias("lines"), F.count("malformed_line").alias("malformed"))
    return reduce(lambda a, b: a.unionByName(b), [counted(scan(spark, h, files)) for h, files in headers(spark, path).items()])
