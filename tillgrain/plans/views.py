"""Registered queries: views over the forecast shown to a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillgrain.operators import forecast as fc, menu, views
from tillgrain.plans import forecast as pf
from tillgrain.plans import facts
from tillgrain.plans.facts import real, real_hours, with_lines
from tillgrain.plans.params import AS_OF, PERIOD
from tillgrain.session import through_table
from tillgrain.sources import sales as src


def days(spark: SparkSession, d: str) -> DataFrame:
    """Daily forecast of the window: PERIOD days from the first one that is due."""
    return through_table(fc.window_slice(pf.service(spark, d), pf.data_end(spark, d), AS_OF, PERIOD), "window")


def items(spark: SparkSession, d: str) -> DataFrame:
    return menu.items(facts.lines(spark, d))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return fc.residual_stats(pf.history_of(pf.fitted_total(spark, d)))


def priced_cells(spark: SparkSession, d: str) -> DataFrame:
    """The history by product with its price: both are dealt by product before they
    meet, so nothing is exchanged for it."""
    prices = menu.first_prices(facts.lines(spark, d))
    return through_table(fc.cells(pf.rows(spark, d)).join(prices, ["user_id", "product"], "left"), "priced-cells")


def totals(spark: SparkSession, d: str) -> DataFrame:
    return views.product_totals(days(spark, d), pf.cells(spark, d), items(spark, d))


def breakdown(spark: SparkSession, d: str) -> DataFrame:
    window = days(spark, d)
    sums = views.product_totals(window, pf.cells(spark, d), items(spark, d))
    return views.breakdown(sums, real(spark, d), window.groupBy("user_id").agg(F.count("*").alias("n_days")))


QUERIES = {
    "fc_revenue_profit": with_lines(lambda s, d: views.revenue_profit(days(s, d), pf.cells(s, d), items(s, d))),
    "fc_daily_revenue": with_lines(lambda s, d: views.daily_revenue(days(s, d), pf.cells(s, d), items(s, d))),
    "fc_heatmap": lambda s, d: views.heatmap(days(s, d), pf.cells(s, d), real_hours(s, d)),
    "fc_heatmap_peak": lambda s, d: views.heatmap_peak(days(s, d), pf.cells(s, d), real_hours(s, d)),
    "fc_item": with_lines(lambda s, d: views.item_view(days(s, d), priced_cells(s, d), stats(s, d))),
    "fc_time_of_day_available": lambda s, d: views.time_of_day_available(src.labelled(src.sales(s, d))),
    "fc_period_totals": lambda s, d: views.period_totals(days(s, d), pf.cells(s, d)),
    "fc_period_breakdown": lambda s, d: views.period_breakdown(days(s, d), pf.cells(s, d)),
    "fc_category": with_lines(lambda s, d: views.category_view(days(s, d), pf.cells(s, d), items(s, d), stats(s, d))),
    "fc_category_heatmap": with_lines(lambda s, d: views.heatmap(days(s, d), pf.cells(s, d), real_hours(s, d), items(s, d))),
    "fc_category_items": with_lines(lambda s, d: views.category_items(days(s, d), pf.cells(s, d), items(s, d))),
    "fc_total": with_lines(lambda s, d: views.category_totals(days(s, d), pf.cells(s, d), items(s, d))),
    "fc_total_daily": with_lines(lambda s, d: views.menu_view(days(s, d), pf.cells(s, d), items(s, d), stats(s, d))),
    "fc_top_items": with_lines(lambda s, d: views.top_items(totals(s, d), real(s, d))),
    "fc_bottom_items": with_lines(lambda s, d: views.bottom_items(totals(s, d), real(s, d))),
    "fc_peak_day": lambda s, d: views.peak_day(days(s, d)),
    "fc_seasonality": lambda s, d: views.seasonality(src.sales(s, d)),
    "fc_tips": lambda s, d: views.tips(days(s, d)),
    "fc_summary": lambda s, d: views.summary(days(s, d)),
    "fc_breakdown": with_lines(breakdown),
}
