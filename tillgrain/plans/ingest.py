"""Registered queries: ingest, cleaning, table maintenance and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillgrain.functions import labels
from tillgrain.operators import cleaning as cln, dashboard as dash, tables as tbl
from tillgrain.plans.dashboard import real
from tillgrain.session import SHUFFLE_CLEANUP, drop_path, run_path, settings, stored
from tillgrain.sources import pos_files, sales as src
from tillgrain.streaming import ingest as stream

MODEL_VERSION = "additive-1"
GONE_UPLOAD = 199507
CLEARED_USER = 7
HALF_DELETED = 3


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sales line as an export would carry it."""
    return exported(src.sales(spark, sf_dir))


def order_text(k: Column) -> Column:
    """The order's reference in an export."""
    return F.when(k % 109 == 4, F.lit(None)).otherwise(F.concat(F.lit(" "), F.when(k % 107 == 3, F.lit("")).otherwise(k.cast("string")), F.lit(" ")))


def exported(sales: DataFrame) -> DataFrame:
    """Sales lines as an export: all text, alias headers, with missing labels,
    missing times and broken values at fixed keys."""
    s, k = sales, F.col("order_id")
    cents = F.col("cost_cents")
    when = lambda m, r, v, other: F.when(k % m == r, v).otherwise(other)
    ds = F.col("order_date")
    return s.select(
        "user_id", "is_imputed",
        order_text(k).alias("Order ID"),
        when(113, 5, F.lit(None), F.element_at(F.split("product", "#"), -1)).alias("sku"),
        F.when(k % 97 == 0, "abc").when(k % 89 == 0, "-1").when(k % 83 == 0, "nan").when(k % 79 == 0, "Infinity").when(k % 73 == 0, "1e12").otherwise(F.concat(F.col("quantity").cast("string"), F.lit(".7"))).alias("qty"),
        F.when(k % 101 == 0, "n/a").when(k % 83 == 1, "NaN").otherwise(F.concat((F.col("price_cents") / 100).cast("bigint").cast("string"), F.lit(".00"))).alias("price"),
        F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")).alias("cost"),
        F.col("category").alias("Category"),
        F.concat(F.lit(" "), F.col("product")).alias("name"),
        F.when(k % 103 == 0, "bad-date").when((k % 11 == 1) & (F.dayofmonth(ds) > 12), F.date_format(ds, "dd/MM/yyyy"))
        .when(k % 11 == 2, F.date_format(ds, "yyyy/MM/dd")).when(k % 11 == 3, F.date_format(ds, "M/d/yyyy"))
        .when(k % 11 == 4, F.date_format(ds, "yyyy-MM-dd 00:00:00")).when(k % 11 == 5, F.date_format(ds, "MMM d, yyyy"))
        .when(k % 11 == 6, F.date_format(ds, "yyyyMMdd"))
        .when((k % 11 == 7) & (F.dayofmonth(ds) > 12), F.date_format(ds, "dd/MM/yy")).when(k % 11 == 8, F.date_format(ds, "d-MMM-yy"))
        .when(k % 11 == 9, F.date_format(ds, "EEEE, MMMM d, yyyy")).when(k % 11 == 10, F.date_format(ds, "MM/dd/yy")).otherwise(ds.cast("string")).alias("date"),
        F.when(k % 5 == 0, "").when(k % 13 == 1, F.concat(F.col("hour").cast("string"), F.lit(":15:00")))
        .when(k % 13 == 2, F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":15")))
        .when(k % 13 == 3, F.concat(((F.col("hour") + 11) % 12 + 1).cast("string"), F.lit(":15 "), F.when(F.col("hour") < 12, "AM").otherwise("PM")))
        .otherwise(F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":15:00"))).alias("time"),
        F.when(k % 10 == 0, "").when(k % 10 == 5, "evening").when(k % 10 == 7, "NULL").otherwise(labels.time_period(F.col("hour"))).alias("time_period"),
        when(3, 0, F.lit("nan"), labels.season_met(ds)).alias("season"),
        F.when(k % 4 == 1, "None").when(k % 4 > 1, "Fair").alias("occasion"),
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pos_files.resolve(raw(spark, sf_dir))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export written as text files of two header layouts and scanned again."""
    rows, path = raw(spark, sf_dir), run_path(spark, "exports")
    even = F.col("user_id") % 2 == 0
    write = lambda df, name: df.write.option("header", True).csv(f"{path}/{name}")
    write(rows.filter(even), "a")
    write(rows.filter(~even).select(*reversed(rows.columns)).withColumnsRenamed({"qty": "quantity", "price": "Unit Price"}), "b")
    typed = lambda f: f.withColumns({"user_id": F.col("user_id").cast("int"), "is_imputed": F.col("is_imputed").cast("boolean")})
    found = pos_files.read_csv(spark, f"{path}/*", typed)
    return found.select(*fields(spark, sf_dir).columns)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cln.enriched(cln.normalised(fields(spark, sf_dir)))


def pick(*columns: str):
    return lambda s, d: clean(s, d).select("user_id", "order_reference", "sku", *columns)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return src.sales(spark, d).select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit(":"), F.col("order_id")).alias("order_reference"),
        "order_date", "product", "category", "quantity", "price_cents", F.lit("first").alias("file"),
    )


def _old(df: DataFrame) -> DataFrame:
    return df.filter(F.year("order_date") <= 1998)


def _new(df: DataFrame) -> DataFrame:
    """The second upload: overlaps the first one by a year."""
    return df.filter(F.year("order_date") >= 1998).withColumn("file", F.lit("second"))


def _dims(df: DataFrame) -> DataFrame:
    return df.select(F.col("product").alias("sku"), F.concat("file", F.lit(" "), "product").alias("name_en"), "category")


def upsert_dims(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    existing = _dims(_old(lines)).distinct()
    return tbl.upsert_dims(existing, _dims(_new(lines)), "sku", ["name_en", "category"])


def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = _lines(spark, d).select("order_reference", "order_date", "file").distinct()
    return tbl.upsert_orders(_old(orders), _new(orders))


def replace_items(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    again = _new(lines).withColumn("quantity", F.col("quantity") + 1)
    return tbl.replace_items(_old(lines), again)


def resolve_fk(spark: SparkSession, d: str) -> DataFrame:
    t = src.star(spark, d)
    return tbl.resolve_keys(t["order_items"], t["orders"].filter(~F.col("is_imputed")), t["products"].filter(F.col("category") != "Gadgets"))


def delete_upload(spark: SparkSession, d: str) -> DataFrame:
    t = src.star(spark, d)
    gone = t["uploads"].filter(F.col("upload_id") == GONE_UPLOAD).select("upload_id")
    return tbl.table_counts(tbl.delete_uploads(t, gone))


def replace_all(spark: SparkSession, d: str) -> DataFrame:
    """A workspace starts over: what is wiped from it, its forecast runs included,
    what is left of the others, and the tables after its last upload came in again."""
    t = src.star(spark, d)
    runs = t["uploads"].select("upload_id", "user_id")  # one forecast run was stored after every upload
    mine = t["uploads"].filter(F.col("user_id") == CLEARED_USER)
    last = mine.agg(F.max("upload_id").alias("upload_id"))
    wiped = tbl.workspace_counts(t, CLEARED_USER).withColumnRenamed("rows", "wiped")
    left = tbl.clear_workspace(t, CLEARED_USER)
    again = tbl.restore_upload(left, t, last)
    counts = wiped.join(tbl.table_counts(left, "kept"), "table").join(tbl.table_counts(again, "imported"), "table")
    gone = F.count_if(F.col("user_id") == CLEARED_USER)
    forecasts = runs.agg(F.lit("forecasts").alias("table"), gone.alias("wiped"), (F.count("*") - gone).alias("kept"), (F.count("*") - gone).alias("imported"))
    return counts.unionByName(forecasts)


def orphan_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that a deletion which stopped halfway has left without orders: it
    had removed the orders of every tenth upload."""
    t = src.star(spark, d)
    left = t["orders"].filter(F.col("upload_id") % 10 != HALF_DELETED)
    return tbl.orphan_uploads(t["uploads"], left).select("upload_id", "user_id")


def seed_refs(spark: SparkSession, d: str) -> DataFrame:
    f = fields(spark, d).withColumn("order_reference", F.when(F.col("is_imputed"), F.lit("nan")).otherwise(F.trim("order_reference")))
    made = cln.seed_references(f).withColumn("synthetic", F.col("order_reference").startswith("syn:"))
    return made.groupBy("user_id", "is_imputed", "synthetic").agg(
        F.count("*").alias("rows"), F.countDistinct("order_reference").alias("references")
    )


def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The export as a stream of files, an order in one of them: cleaned like an
    upload, merged by order over several batches, totals per order. Lines are dealt
    to the files before they become text, which takes several times the room."""
    inbox, lines = run_path(spark, "stream-inbox"), run_path(spark, "stream-lines")
    sales = stored(src.sales(spark, d), lines)
    rows = exported(sales.repartition(6, "user_id", F.coalesce(F.trim(order_text(F.col("order_id"))), F.lit(""))))
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        rows.write.option("compression", "zstd").parquet(inbox)
    drop_path(spark, lines)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(inbox)
    clean = lambda batch: cln.valid_rows(cln.enriched(cln.normalised(pos_files.resolve(batch))))
    table = run_path(spark, "stream-items")
    stream.start(source, table, run_path(spark, "stream-log"), clean=clean).awaitTermination()
    return stream.current(spark, table).groupBy("order_reference").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))


def sink_report(spark: SparkSession, d: str) -> DataFrame:
    """All panels as one sectioned file per workspace, with the chain's roll-up,
    written as CSV and read back."""
    sales = real(spark, d)
    cents = lambda c: F.rint(F.col(c) * 100).cast("bigint")
    row = F.lit(1)
    lines = sales.groupBy("user_id").agg(
        F.sum(F.col("quantity") * F.col("price_cents")).alias("revenue"), F.sum("quantity").alias("units"), F.countDistinct("order_id").alias("orders"), F.countDistinct("order_date").alias("days"))
    chain = lines.agg(F.lit(0).alias("user_id"), *[F.sum(c).alias(c) for c in ("revenue", "units", "orders")], F.count("*").alias("days"))
    long = lambda df, names: df.select("user_id", F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).cast("bigint").alias("value")) for c, n in names.items()])))
    kpis = long(lines, {"revenue": "revenue_cents", "orders": "orders", "units": "units", "days": "open_days"})
    every = long(chain, {"revenue": "revenue_cents", "orders": "orders", "units": "units", "days": "workspaces"})
    report = tbl.report({
        "kpi": (kpis, row, F.col("key"), F.col("value")),
        "trend": (dash.monthly_growth(sales), F.regexp_replace("month", "-", ""), F.col("month"), cents("revenue")),
        "categories": (dash.by_category(sales), row, F.col("category"), cents("revenue")),
        "items": (dash.top_revenue(sales), F.col("place"), F.col("product"), cents("revenue")),
        "chain": (every, row, F.col("key"), F.col("value")),
    })
    path = run_path(spark, "report")
    tbl.write_table(report, path, "csv")
    return spark.read.schema(report.schema).option("header", True).csv(path)


QUERIES = {
    "src_csv": csv_files,
    "ing_upsert_dims": upsert_dims,
    "ing_upsert_orders": upsert_orders,
    "ing_replace_items": replace_items,
    "ing_resolve_fk": resolve_fk,
    "ing_replace_all": replace_all,
    "ing_summary": lambda s, d: cln.summary(clean(s, d), ["user_id"]),
    "tbl_upload_history": lambda s, d: (lambda t: tbl.upload_history(t["uploads"], t["orders"], t["order_items"]))(src.star(s, d)),
    "tbl_delete_upload": delete_upload,
    "tbl_clear": lambda s, d: tbl.table_counts(tbl.clear_workspace(src.star(s, d), CLEARED_USER)),
    "tbl_orphan_uploads": orphan_uploads,
    "tbl_quality_counts": lambda s, d: tbl.quality_counts(src.star(s, d)),
    "ing_seed_refs": seed_refs,
    "ing_stream": ingest_stream,
    "sink_signature": lambda s, d: tbl.signature(src.sales(s, d), MODEL_VERSION),
    "sink_report_csv": sink_report,
    "cln_order_ref": lambda s, d: clean(s, d).select("user_id", "order_reference"),
    "cln_fallbacks": lambda s, d: cln.normalised(fields(s, d).drop("sku")).select("user_id", "sku", "name_en", "name_ar", "category_en", "category_ar"),
    "cln_numeric": pick("quantity", "unit_price", "unit_cost"),
    "cln_datetime": pick("order_datetime"),
    "cln_time_fallback": lambda s, d: fields(s, d).select("user_id", "time", "time_period", cln.clean_time(F.col("time"), F.col("time_period")).alias("clean_time")),
    "cln_blank": lambda s, d: fields(s, d).select("user_id", "season", "occasion", "time_period", *[
        labels.is_blank(F.col(c)).alias(f"blank_{c}") for c in ("season", "occasion", "time_period")]),
    "enr_time_period": pick("order_datetime", "time_period"),
    "enr_season_met": pick("order_datetime", "season"),
    "enr_occasion": pick("order_datetime", "occasion"),
    "cln_valid_rows": lambda s, d: cln.valid_rows(clean(s, d)).select("user_id", "order_reference", "sku", "quantity", "unit_price", "order_datetime"),
    "cln_dedup_orders": lambda s, d: cln.first_orders(cln.valid_rows(clean(s, d))).select(
        "user_id", "order_reference", "order_datetime", "time_period", "season", "occasion"),
}
