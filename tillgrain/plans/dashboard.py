"""Registered queries: sources, dashboard, calendar and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillgrain.functions import labels
from tillgrain.functions.numeric import rnd
from tillgrain.functions.tables import values
from tillgrain.operators import calendar as cal, dashboard as dash
from tillgrain.plans import facts
from tillgrain.plans.params import AS_OF
from tillgrain.sources import sales as src

# Monthly base temperature and daily codes of the weather fixture.
MONTH_TEMP = [(1, 19), (2, 22), (3, 26), (4, 32), (5, 38), (6, 41), (7, 42), (8, 42), (9, 39), (10, 34), (11, 26), (12, 21)]
DAY_CODES = [0, 1, 2, 3, 51, 53, 61, 63, 95, 71]


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.real_only(src.sales(spark, sf_dir))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.spine(cal.date_bounds(facts.hours(spark, sf_dir)), "first_ds", "last_ds")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed days derived from the sales dates, one in seven left out."""
    day = F.dayofmonth("ds")
    temps = values(spark, MONTH_TEMP, "mo int, temp int")
    return (
        facts.hours(spark, sf_dir).select(F.col("order_date").alias("ds")).distinct()
        .filter(day % 7 != 3)
        .join(F.broadcast(temps), F.month("ds") == F.col("mo"))
        .select(
            "ds",
            (F.col("temp").cast("double") + (day % 3).cast("double")).alias("temp_max"),
            F.get(F.array(*[F.lit(c) for c in DAY_CODES]), day % 10).cast("int").alias("weather_code"),
        )
    )


def _scope(spark: SparkSession, d: str) -> DataFrame:
    users = src.star(spark, d)["users"]
    totals = src.sales(spark, d).groupBy("user_id").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("units")
    )
    return src.scoped(totals, users).select("user_id", "workspace_id", "rows", "units")


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return cal.date_bounds(src.sales(spark, d))


QUERIES = {
    "src_sales": src.sales,
    "src_scope": _scope,
    "src_real_only": real,
    "src_derive": lambda s, d: src.derived(src.sales(s, d)).select(
        "user_id", "order_id", "line_no", "product", "order_date", "hour", "day_name", "quantity",
        "total_price", "product_cost", "profit", "margin_pct"),
    "src_filter": lambda s, d: src.filtered(src.sales(s, d), "1996-03-01", "1999-08-31", "Sweets"),
    "dash_kpis": lambda s, d: dash.kpis(real(s, d)),
    "dash_last30": lambda s, d: dash.last30(real(s, d)),
    "dash_prev30_delta": lambda s, d: dash.prev30_delta(real(s, d)),
    "dash_has_comparison": lambda s, d: dash.has_comparison(real(s, d)),
    "dash_best_seller": lambda s, d: dash.best_seller(real(s, d)),
    "dash_worst_seller": lambda s, d: dash.worst_seller(real(s, d)),
    "dash_busiest_day": lambda s, d: dash.busiest_day(real(s, d)),
    "dash_dow_stats": lambda s, d: dash.dow_stats(real(s, d)),
    "dash_daily": lambda s, d: dash.daily(real(s, d)),
    "dash_monthly_growth": lambda s, d: dash.monthly_growth(real(s, d)),
    "dash_by_category": lambda s, d: dash.by_category(real(s, d)),
    "dash_top_revenue": lambda s, d: dash.top_revenue(real(s, d)),
    "dash_top_qty": lambda s, d: dash.top_qty(real(s, d)),
    "dash_heatmap": lambda s, d: dash.heatmap(real(s, d)),
    "dash_heatmap_norm": lambda s, d: dash.heatmap_norm(real(s, d)),
    "dash_category_list": lambda s, d: dash.category_list(real(s, d)),
    "dash_data_range": lambda s, d: dash.data_range(src.sales(s, d), AS_OF),
    "dash_reliability": lambda s, d: dash.reliability(src.sales(s, d), AS_OF),
    "dash_products": lambda s, d: dash.products(src.sales(s, d), "all"),
    "dash_rollup": lambda s, d: dash.rollup(real(s, d), "1997-01-01", "1999-12-31"),
    "dash_special_days": lambda s, d: dash.special_days(real(s, d)),
    "cal_spine": lambda s, d: cal.spine(cal.date_bounds(src.sales(s, d), ["user_id"]), "first_ds", "last_ds", ["user_id"]),
    "cal_hijri": lambda s, d: cal.with_calendar(days(s, d), ["hijri_month", "hijri_day"]),
    "cal_season_local": lambda s, d: days(s, d).withColumn("season", labels.season_local(F.col("ds"))),
    "cal_payday": lambda s, d: days(s, d).withColumn("is_payday", labels.is_payday(F.col("ds"))),
    "cal_occasion": lambda s, d: cal.with_calendar(days(s, d), ["occasion"]),
    "cal_holidays": lambda s, d: cal.holidays(s, _bounds(s, d)),
    "cal_holiday_expand": lambda s, d: cal.holiday_days(cal.holidays(s, _bounds(s, d))),
    "cal_notable": lambda s, d: cal.notable_events(days(s, d)),
    "cal_regressors": lambda s, d: cal.regressors(days(s, d)),
    "cal_islands": lambda s, d: cal.islands(cal.with_calendar(days(s, d), ["occasion"]), ["occasion"])
        .groupBy("occasion", "island").agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.count("*").alias("days"))
        .drop("island"),
    "cal_occ_family": lambda s, d: cal.with_calendar(days(s, d), ["occasion"]).select("ds", labels.occasion_family(F.col("occasion")).alias("occ_family")),
    "cal_onehot": lambda s, d: cal.one_hot_season(days(s, d)),
    "wx_daily_temp": lambda s, d: cal.daily_temperature(days(s, d), weather(s, d)).withColumn("temp_max", rnd(F.col("temp_max"), 6)),
    "wx_fill": lambda s, d: cal.fill_temperature(cal.daily_temperature(days(s, d), weather(s, d))).withColumn("temp_max", rnd(F.col("temp_max"), 6)),
    "wx_decode": lambda s, d: cal.weather_condition(weather(s, d)).select("ds", "weather_code", "weather_condition"),
}
