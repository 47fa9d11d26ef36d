"""The facts a query call reads, stored once and shared by its operators."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillgrain.session import made, once, through_table
from tillgrain.sources import sales as src


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The joined sales lines: operators scan them instead of joining again."""
    return once(("lines", d), lambda: through_table(src.sales(spark, d), "lines"))


#: what quantities by product, day and hour need of a line
UNITS = ("user_id", "product", "order_date", "hour", "quantity", "is_imputed")


def units(spark: SparkSession, d: str) -> DataFrame:
    """The same lines without prices, keys and categories: half of what is stored
    and exchanged. A query that reads ``lines`` too takes them from there, see
    ``with_lines``."""
    whole = made(("lines", d))
    if whole is not None:
        return whole.select(*UNITS)
    return once(("units", d), lambda: through_table(src.sales(spark, d).select(*UNITS), "units"))


def with_lines(query):
    """A query whose operators read ``lines`` and ``units``: sales are stored once."""
    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        lines(spark, d)
        return query(spark, d)
    return run


def real(spark: SparkSession, d: str) -> DataFrame:
    return src.real_only(lines(spark, d))


def real_units(spark: SparkSession, d: str) -> DataFrame:
    return src.real_only(units(spark, d))


def hours(spark: SparkSession, d: str) -> DataFrame:
    """Quantity of every hour of a workspace: all that daily series, date spans and
    hour shares need, bounded by the calendar."""
    return once(("hours", d), lambda: through_table(
        units(spark, d).groupBy("user_id", "order_date", "hour", "is_imputed").agg(F.sum("quantity").alias("quantity")), "hours"))


def real_hours(spark: SparkSession, d: str) -> DataFrame:
    return src.real_only(hours(spark, d))
