"""The sales fact scan every analytic reads, one row per order line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillgrain.functions import labels
from tillgrain.functions.numeric import money, rnd, share

SALES_COLUMNS = (
    "user_id", "order_id", "order_date", "hour", "product", "category",
    "quantity", "price_cents", "cost_cents", "is_imputed", "line_no",
)


def _category(kind: Column) -> Column:
    return (
        F.when(kind == "ECONOMY", "Espresso Drinks")
        .when(kind == "SMALL", "Sweets")
        .when(kind == "MEDIUM", "Cold Drinks")
        .when(kind == "LARGE", "Hot Sweets")
        .when(kind == "PROMO", "Dripp Coffee Drinks")
        .otherwise("Gadgets")
    )


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star schema (users, uploads, categories, products, orders,
    order_items) as views over the given tables. An upload is one workspace's
    orders of one year; every third workspace is a sub-user of the one before."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, part = read("customer"), read("part")
    users = read("nation").select(
        F.col("n_nationkey").cast("int").alias("id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 == 2, F.col("n_nationkey") - 1).cast("int").alias("parent_id"),
    )
    orders = (
        read("orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").cast("bigint").alias("order_id"),
            (F.year("o_orderdate") * 100 + F.col("c_nationkey")).cast("bigint").alias("upload_id"),
            F.to_date("o_orderdate").alias("order_date"),
            (F.col("o_orderkey") % 24).cast("int").alias("hour"),
            (F.col("o_orderstatus") == "P").alias("is_imputed"),
        )
    )
    uploads = (
        orders.groupBy("upload_id")
        .agg(F.max("order_date").alias("uploaded_at"))
        .select(
            "upload_id",
            (F.col("upload_id") % 100).cast("int").alias("user_id"),
            F.concat(F.lit("sales_"), F.col("upload_id").cast("string"), F.lit(".csv")).alias("filename"),
            "uploaded_at",
        )
    )
    products = part.select(
        F.col("p_partkey").cast("bigint").alias("product_id"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("product"),
        _category(F.col("p_type")).alias("category"),
        F.col("p_size").cast("int").alias("size"),
    )
    items = read("lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("order_id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        F.col("l_linenumber").cast("int").alias("line_no"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint").alias("unit"),
    )
    return {"users": users, "uploads": uploads, "products": products, "orders": orders, "order_items": items}


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items x orders x workspace x products, as one wide frame in integer cents.

    No join hints: the sides grow with the data, so the size-checked broadcast
    threshold and AQE (including its skew split) choose the strategy.
    """
    t = star(spark, sf_dir)
    return (
        t["order_items"]
        .join(t["orders"], "order_id")
        .join(t["products"], "product_id")
        .select(
            (F.col("upload_id") % 100).cast("int").alias("user_id"),
            "order_id", "order_date", "hour", "product", "category", "quantity",
            (F.col("unit") * 100).alias("price_cents"),
            (F.col("unit") * (F.col("size") + 20)).cast("bigint").alias("cost_cents"),
            "is_imputed", "line_no",
        )
    )


def real_only(df: DataFrame) -> DataFrame:
    """Leave out imputed orders; the predicate reaches the orders scan."""
    return df.filter(~F.col("is_imputed"))


def scoped(df: DataFrame, users: DataFrame) -> DataFrame:
    """Put every row in the workspace its user works in: the parent's, if any."""
    owner = users.select(
        F.col("id").alias("user_id"), F.coalesce("parent_id", "id").alias("workspace_id")
    )
    return df.join(owner, "user_id")


def filtered(df: DataFrame, start: str | None = None, end: str | None = None, category: str | None = None) -> DataFrame:
    """Optional inclusive date range and category equality ('all' = none)."""
    if start:
        df = df.filter(F.col("order_date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("order_date") <= F.lit(end).cast("date"))
    if category and category.lower() != "all":
        df = df.filter(F.col("category") == category)
    return df


def derived(df: DataFrame) -> DataFrame:
    """Line measures in currency units: total, cost, profit and margin."""
    total, cost = F.col("quantity") * F.col("price_cents"), F.col("quantity") * F.col("cost_cents")
    return df.withColumns({
        "day_name": labels.day_name(F.col("order_date")),
        "total_price": money(total),
        "product_cost": money(cost),
        "profit": money(total - cost),
        "margin_pct": rnd(share(total - cost, total) * 100.0),
    })


def labelled(df: DataFrame) -> DataFrame:
    """Attach the period of the day, the demand season and the weekday."""
    return df.withColumns({
        "time_period": labels.time_period(F.col("hour")),
        "season": labels.season_local(F.col("order_date")),
        "dow": labels.dow(F.col("order_date")),
    })
