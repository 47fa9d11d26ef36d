"""Registered queries: forecast input, shares, fits and post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillgrain.functions.numeric import rnd
from tillgrain.operators import calendar, factored, fit, forecast as fc, menu, tables as tbl
from tillgrain.plans import facts
from tillgrain.plans.dashboard import weather
from tillgrain.plans.params import AS_OF, LONG_PERIOD, PERIOD
from tillgrain.session import made, once, through_table
from tillgrain.sources import sales as src


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Sales with labels; hour 4 stands for lines without a period."""
    return labels_of(src.sales(spark, d))


def labels_of(sales: DataFrame) -> DataFrame:
    rows = src.labelled(sales).withColumn("time_period", F.when(F.col("hour") != 4, F.col("time_period")))
    return calendar.with_calendar(rows, ["occasion"], "order_date")


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines that fits and shares read: those with all model labels."""
    return fc.model_rows(labels_of(facts.units(spark, d)))


def hour_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same lines added up by hour."""
    return fc.model_rows(labels_of(facts.hours(spark, d)))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return once(("daily", d), lambda: through_table(fc.daily(hour_rows(spark, d)), "daily"))


def lone_daily(spark: SparkSession, d: str) -> DataFrame:
    """The daily series for a query that needs nothing else: one pass, not stored."""
    return fc.daily(fc.model_rows(labelled(spark, d)))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The history by product; where a query has made it with its days, that one."""
    with_days = made(("day-cells", d))
    return with_days if with_days is not None else once(("cells", d), lambda: through_table(fc.cells(rows(spark, d)), "cells"))


def day_cells(spark: SparkSession, d: str) -> DataFrame:
    """The history by product, with the days of its slots."""
    return once(("day-cells", d), lambda: through_table(fc.cells(rows(spark, d), days=True), "day-cells"))


def data_end(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).groupBy("user_id").agg(F.max("ds").alias("data_end"))


def last_day(period: int):
    return F.date_add(F.greatest(F.col("data_end"), F.lit(AS_OF).cast("date")), period)


def design(spark: SparkSession, d: str) -> DataFrame:
    """Features of every date of the span and the longest horizon."""
    last = F.date_add(F.greatest(F.col("last_ds"), F.lit(AS_OF).cast("date")), LONG_PERIOD)
    all_days = calendar.spine(calendar.date_bounds(facts.hours(spark, d)), F.col("first_ds"), last)
    return fc.features(all_days, weather(spark, d).select("ds", "temp_max"))


def until(history: DataFrame, ends: DataFrame, period: int) -> DataFrame:
    return history.join(ends.select("user_id", last_day(period).alias("until")), "user_id")


def fitted_total(spark: SparkSession, d: str) -> DataFrame:
    """The model of every workspace: its days and all days to come, stored once."""
    history = until(daily(spark, d), data_end(spark, d), LONG_PERIOD)
    done = fit.fit(history, ["user_id"], design(spark, d), [fit.Model("full", days="span")])
    return once(("fitted", d), lambda: through_table(done, "fitted"))


def holdout_mae(spark: SparkSession, d: str) -> DataFrame:
    return fit.holdout_mae(fit.fit(daily(spark, d), ["user_id"], design(spark, d), [fit.Model("holdout", part=0.8)]))


def history_of(fitted: DataFrame) -> DataFrame:
    return fitted.filter(F.col("y").isNotNull()).select("user_id", "ds", F.col("y").cast("bigint").alias("y"), "is_imputed", "yhat")


def ahead_of(fitted: DataFrame, ends: DataFrame, period: int = PERIOD) -> DataFrame:
    """Raw forecast of the days after the data's end."""
    return fitted.join(ends, "user_id").filter((F.col("ds") > F.col("data_end")) & (F.col("ds") <= last_day(period))).select("user_id", "ds", "yhat")


def ahead(spark: SparkSession, d: str, period: int = PERIOD) -> DataFrame:
    return ahead_of(fitted_total(spark, d), data_end(spark, d), period)


def service(spark: SparkSession, d: str, period: int = PERIOD) -> DataFrame:
    """The forecast as shown: brought to the historical level, then holidays lifted."""
    raw = ahead(spark, d, period)
    scale = fc.baseline_scale(raw, fc.history_rate(hour_rows(spark, d)))
    return through_table(fc.calibrate(fc.apply_scale(raw, scale).select("user_id", "ds", "yhat"), daily(spark, d)), "service")


def naive_future(spark: SparkSession, d: str, period: int = PERIOD) -> DataFrame:
    history = daily(spark, d)
    return fc.naive_dow(history, fc.future_days(history, AS_OF, period)).select("user_id", "ds", "yhat")


def actuals(spark: SparkSession, d: str) -> DataFrame:
    """Observed cells with the fitted model's prediction, and the forecast's grid."""
    c, fitted = day_cells(spark, d), fitted_total(spark, d)
    past = factored.observed(history_of(fitted), c)
    return factored.with_actuals(past, factored.expand(service(spark, d), c))


def forecast_run(spark: SparkSession, d: str) -> DataFrame:
    """Run record from the factors: the grid's size is products x periods x days."""
    c, days = day_cells(spark, d), service(spark, d)
    past = factored.observed_periods(factored.observed(history_of(fitted_total(spark, d)), c))
    return tbl.forecast_run(past, days, c, PERIOD, "additive")


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """The forecast's rows in output order: product by volume, then date; the
    four periods of a row stand in their order."""
    c, days = cells(spark, d), service(spark, d)
    return fc.ordered(factored.expand(days, c, more=("product_place",), known=fc.with_places(c)), days)


def product_fits(spark: SparkSession, d: str, top: DataFrame) -> DataFrame:
    """One fit per top product: every day from its first sale to the horizon."""
    keys = ["user_id", "product"]
    history = fc.daily(rows(spark, d).join(top, keys, "left_semi"), tuple(keys))
    return fit.fit(until(history, data_end(spark, d), PERIOD), keys, design(spark, d), [fit.Model("product", days="span")])


def own_periods(spark: SparkSession, d: str, c: DataFrame, top: DataFrame) -> DataFrame:
    return fit.split_by_period(product_fits(spark, d, top), c.join(top, ["user_id", "product"], "left_semi"))


def per_product(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return own_periods(spark, d, c, fc.first_products(c))


def tail_fit(spark: SparkSession, d: str, top: DataFrame) -> DataFrame:
    history = fc.daily(fc.without(rows(spark, d), top))
    done = fit.fit(until(history, data_end(spark, d), PERIOD), ["user_id"], design(spark, d), [fit.Model("tail", days="span")])
    return through_table(done, "tail")


def tail(spark: SparkSession, d: str) -> DataFrame:
    """Long tail: one total fit per workspace, split by shares and normalised."""
    c = cells(spark, d)
    top = fc.first_products(c)
    days = through_table(ahead_of(tail_fit(spark, d, top), data_end(spark, d)), "tail-days")
    return factored.expand(days, fc.without(c, top))


def by_product(spark: SparkSession, d: str) -> DataFrame:
    """Per-product predictions with actuals: top products by their own fits, the
    rest by the tail's, history where observed and all days to come."""
    c = day_cells(spark, d)
    top = fc.first_products(c)
    own = through_table(own_periods(spark, d, c, top), "product-periods")
    seen = fc.observed_cells(rows(spark, d).join(top, ["user_id", "product"], "left_semi"))
    ends = data_end(spark, d)
    long = fit.long_periods(own).join(seen, ["user_id", "ds", "product", "time_period"])
    future = own.join(ends, "user_id").filter(F.col("ds") > F.col("data_end")).drop("data_end", "y")
    tail_daily, tail_cells = tail_fit(spark, d, top), fc.without(c, top)
    past = factored.by_period(long).unionByName(factored.observed(history_of(tail_daily), tail_cells))
    grid = factored.expand(ahead_of(tail_daily, ends), tail_cells)
    return factored.with_actuals(past, future.unionByName(grid))


def floored(spark: SparkSession, d: str) -> DataFrame:
    """Per product: its total over the horizon and what the floor makes of it."""
    c, days = cells(spark, d), service(spark, d)
    sums = factored.product_totals(days, c)
    n_days = days.groupBy("user_id").agg(F.count("*").alias("n_days"))
    out = fc.baseline_floor(sums, n_days, fc.baseline_per_product(facts.units(spark, d)))
    floor = F.col("total") * F.col("scale") + F.col("fill") * F.col("n_days") * 4
    return out.select("user_id", "product", rnd(floor, 3).alias("total"))


def sliced(spark: SparkSession, d: str) -> DataFrame:
    """A reversed range that starts before the first future day."""
    ends = data_end(spark, d)
    out = fc.window_slice(ahead(spark, d, LONG_PERIOD), ends, AS_OF, PERIOD, "2001-09-10", "2001-07-20")
    return out.join(fc.required_horizon(ends, AS_OF, PERIOD, "2001-09-10"), "user_id")


def scaled(spark: SparkSession, d: str) -> DataFrame:
    raw = ahead(spark, d)
    return fc.apply_scale(raw, fc.baseline_scale(raw, fc.history_rate(hour_rows(spark, d))))


#: series of the earlier script: a workspace's categories
SERIES = ["user_id", "category"]

QUERIES = {
    "fc_input": lambda s, d: fc.input_frame(labelled(s, d)),
    "fc_daily": lambda s, d: lone_daily(s, d).select("user_id", "ds", "y"),
    "fc_imputed_day": lambda s, d: lone_daily(s, d).select("user_id", "ds", "is_imputed"),
    "fc_partial_days": lambda s, d: fc.partial_days(lone_daily(s, d), "Normal Day").select("user_id", "ds", "y", "dow_median", "is_partial"),
    "fc_weights": lambda s, d: fc.weighted(lone_daily(s, d)).select("user_id", "ds", "weight"),
    "fc_features": lambda s, d: design(s, d).select("ds", *[rnd(F.col(c), 9).alias(c) if c in fc.WEEKLY or c == "temp_max" else c for c in fc.FEATURES]),
    "fc_fit_total": lambda s, d: fitted_total(s, d).select("user_id", "ds", "y", "yhat"),
    "fc_holdout_mae": holdout_mae,
    "fc_clip": lambda s, d: fc.clip(fitted_total(s, d).select("user_id", "ds", rnd(F.col("raw"), fit.DIGITS).alias("yhat"))),
    "fc_residual_stats": lambda s, d: fc.residual_stats(history_of(fitted_total(s, d))),
    "fc_naive_dow": naive_future,
    "fc_share": lambda s, d: fc.observed_share(cells(s, d)).withColumn("fraction", rnd(F.col("fraction"), 9)),
    "fc_share_fallback": lambda s, d: fc.fallback_share(cells(s, d)).withColumn("fallback", rnd(F.col("fallback"), 9)),
    "fc_disaggregate": lambda s, d: factored.expand(service(s, d), cells(s, d)),
    "fc_actuals": actuals,
    "fc_order": ordered,
    "fc_top_products": lambda s, d: fc.top_products(cells(s, d)),
    "fc_fit_product": per_product,
    "fc_fit_tail": tail,
    "fc_per_product": by_product,
    "fc_baseline_scale": scaled,
    "fc_calibrate": lambda s, d: fc.calibrate(ahead(s, d, LONG_PERIOD), daily(s, d)),
    "fc_baseline_per_product": lambda s, d: fc.baseline_per_product(src.sales(s, d)).withColumn("per_day", rnd(F.col("per_day"), 6)),
    "fc_baseline_floor": floored,
    "fc_weekday_floor": lambda s, d: fc.weekday_floor(ahead(s, d), daily(s, d)).withColumn("yhat", rnd(F.col("yhat"), 5)),
    "fc_slice": sliced,
    "fc_price_lookup": lambda s, d: menu.items(src.sales(s, d)).select("user_id", "product", "price", "cost"),
    "fc_round_total": lambda s, d: fc.round_to_total(service(s, d), ["user_id"]),
    "fc_band": lambda s, d: fc.band(service(s, d), fc.residual_stats(history_of(fitted_total(s, d))), "yhat"),
    "fc_legacy_dense": lambda s, d: fit.dense_series(src.sales(s, d), SERIES),
    "fc_legacy_fit": lambda s, d: fit.legacy_fit(fit.dense_series(src.sales(s, d), SERIES), SERIES),
    "fc_legacy_scores": lambda s, d: fit.legacy_scores(fit.legacy_fit(fit.dense_series(src.sales(s, d), SERIES), SERIES), SERIES),
    "sink_forecast_run": forecast_run,
}
