"""Views over the daily forecast and the shares of its slots: menu, category and
item level. Sums are taken on the factors (``factored``); only the item views,
whose result is a row per product and day, multiply out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from tillgrain.functions import labels
from tillgrain.functions.numeric import micro_mean, micro_sum, rnd, share, whole
from tillgrain.functions.ranking import top_k
from tillgrain.operators import calendar, factored, grid
from tillgrain.operators.dashboard import dense_hours
from tillgrain.operators.forecast import band, round_to_total
from tillgrain.session import through_table

MIN_HISTORY = 30
SEASONAL_PCT = 70.0
CATEGORY = ["user_id", "category"]


def priced(items: DataFrame) -> DataFrame:
    """Price and profit per unit; unknown ones count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return items.select("user_id", "product", "category", zero("price").alias("price"), (zero("price") - zero("cost")).alias("unit_profit"))


def money_of(*names: str) -> dict:
    """Values per unit that the sums over cells are taken of."""
    column = {"revenue": "price", "profit": "unit_profit"}
    return {n: F.coalesce(column[n], F.lit(0.0)) for n in names}


def revenue_profit(days: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    by_day = factored.by_day(days, cells, money_of("revenue", "profit"), items=priced(items))
    return by_day.groupBy("user_id").agg(rnd(micro_sum(F.col("revenue"), 4)).alias("revenue"), rnd(micro_sum(F.col("profit"), 4)).alias("profit"))


def daily_revenue(days: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    return factored.by_day(days, cells, money_of("revenue"), items=priced(items)).withColumn("revenue", rnd(F.col("revenue")))


def _peaked(days: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the day with the largest integer, the first on ties. One row per
    day and series in the window."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("units").desc(), "ds"))
    return days.withColumn("is_peak", at == 1)


def _view(days: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Daily integers, revenue, bands and peak day per series of ``keys``."""
    done = _peaked(round_to_total(days.withColumn("revenue", rnd(F.col("revenue"))), keys), keys)
    return band(done, stats, "units", "revenue").select(
        *keys, "ds", "units", "units_low", "units_high", "revenue", "revenue_low", "revenue_high", "is_peak"
    )


def item_view(days: DataFrame, cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Integers, revenue, bands and peak of every product's days. ``cells`` has the
    ``price`` of each product. The days of many products are one array until the
    end, so nothing is sorted or exchanged by product and day."""
    done = grid.product_units(days, cells, "price")
    return band(done, through_table(stats, "stats"), "units", "revenue").select(
        "user_id", "product", "ds", "units", "units_low", "units_high", "revenue", "revenue_low", "revenue_high", "is_peak")


def category_view(days: DataFrame, cells: DataFrame, items: DataFrame, stats: DataFrame) -> DataFrame:
    values = {"yhat": F.lit(1.0), **money_of("revenue")}
    return _view(factored.by_day(days, cells, values, ["category"], priced(items)), stats, CATEGORY)


def menu_view(days: DataFrame, cells: DataFrame, items: DataFrame, stats: DataFrame) -> DataFrame:
    rows = factored.by_day(days, cells, money_of("revenue"), items=priced(items))
    return _view(days.join(rows, ["user_id", "ds"]), stats, ["user_id"])


def peak_day(days: DataFrame) -> DataFrame:
    return _peaked(round_to_total(days, ["user_id"]), ["user_id"]).filter("is_peak").select("user_id", "ds", "units")


def time_of_day_available(sales: DataFrame) -> DataFrame:
    named = F.when(~labels.is_blank(F.col("time_period")), F.lower("time_period"))
    return sales.groupBy("user_id").agg((F.countDistinct(named) >= 2).alias("available"))


def period_totals(days: DataFrame, cells: DataFrame) -> DataFrame:
    """Four rows per product, rounded after summing."""
    return factored.totals(days, cells).select("user_id", "product", "time_period", whole(F.col("total")).alias("units"))


def period_breakdown(days: DataFrame, cells: DataFrame) -> DataFrame:
    """Whole units of every product and day, a column for each period."""
    return factored.expand(days, cells).select("user_id", "product", "ds", *[F.col(p).cast("int").alias(p) for p in labels.PERIODS])


def product_totals(days: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    return factored.product_totals(days, cells).join(items.select("user_id", "product", "category"), ["user_id", "product"], "left")


def category_items(days: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    """Item totals of every category, truncated to units."""
    return product_totals(days, cells, items).select("user_id", "category", "product", F.col("total").cast("bigint").alias("units"))


def category_totals(days: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    return product_totals(days, cells, items).groupBy("user_id", "category").agg(
        micro_sum(F.col("total")).cast("bigint").alias("units"), F.count("*").alias("item_count")
    )


def _with_history(totals: DataFrame, real: DataFrame) -> DataFrame:
    history = real.groupBy("user_id", "product").agg(F.sum("quantity").alias("history"))
    return totals.join(history, ["user_id", "product"], "left").withColumn("history", F.coalesce("history", F.lit(0)))


def top_items(totals: DataFrame, real: DataFrame, n: int = 5) -> DataFrame:
    rows = top_k(_with_history(totals, real), ["user_id"], [F.col("total").desc(), F.col("product")], n)
    return rows.select("user_id", "product", "category", F.col("total").cast("bigint").alias("units"), "history", "place")


def bottom_items(totals: DataFrame, real: DataFrame, n: int = 5) -> DataFrame:
    """Slow movers: at least one unit ahead and 30 in the history."""
    rows = _with_history(totals, real).filter((F.col("total") >= 1.0) & (F.col("history") >= MIN_HISTORY))
    return top_k(rows, ["user_id"], [F.col("total"), F.col("product").desc()], n).select(
        "user_id", "product", "category", F.col("total").cast("bigint").alias("units"), "history", "place"
    )


# -- heatmap -----------------------------------------------------------------


def hour_share(real: DataFrame) -> DataFrame:
    """Share of each hour in its weekday and period, by units of real rows."""
    keys = ["user_id", "dow", "time_period"]
    counts = real.groupBy("user_id", labels.dow(F.col("order_date")).alias("dow"), labels.time_period(F.col("hour")).alias("time_period"), "hour").agg(F.sum("quantity").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, "hour", share(F.col("n"), total).alias("hour_share"))


def _heat(days: DataFrame, cells: DataFrame, real: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Forecast units per weekday and hour and occurrence of the weekday; the
    day is closed in Ramadan until the evening. With ``items``, per category."""
    extra = [] if items is None else ["category"]
    keys = ["user_id", *extra]
    values = factored.by_day(days, cells, {"yhat": F.lit(1.0)}, [*extra, "time_period"], None if items is None else priced(items))
    open_days = calendar.with_calendar(values, ["occasion"])
    closed = (F.col("occasion") == "Ramadan") & F.col("time_period").isin("morning", "Afternoon")
    open_days = open_days.withColumn("yhat", F.when(closed, 0.0).otherwise(F.col("yhat"))).withColumn("dow", labels.dow(F.col("ds")))
    occur = open_days.groupBy(*keys, "dow").agg(F.countDistinct("ds").alias("n_days"))
    slots = open_days.groupBy(*keys, "dow", "time_period").agg(micro_sum(F.col("yhat")).alias("units")).join(occur, [*keys, "dow"])
    hours = slots.join(hour_share(real), ["user_id", "dow", "time_period"]).groupBy(*keys, "dow", "hour").agg(
        micro_sum(F.col("units") / F.col("n_days") * F.col("hour_share")).alias("v")
    )
    grid = dense_hours(values.select(*keys).distinct())
    return grid.join(hours, [*keys, "dow", "hour"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def heatmap_values(days: DataFrame, cells: DataFrame, real: DataFrame) -> DataFrame:
    """Whole units of every open hour, for scoring."""
    return _heat(days, cells, real).select("user_id", "dow", "hour", F.rint("v").alias("pred"))


def heatmap(days: DataFrame, cells: DataFrame, real: DataFrame, items: DataFrame | None = None) -> DataFrame:
    keys = ["user_id"] if items is None else CATEGORY
    return _heat(days, cells, real, items).select(*keys, "dow", "day", "hour", labels.hour_label(F.col("hour")).alias("hour_label"), whole(F.col("v")).alias("value"))


def heatmap_peak(days: DataFrame, cells: DataFrame, real: DataFrame) -> DataFrame:
    """First peak cell in display order and its lead over the mean of the
    cells that are not zero, in %."""
    v = F.col("v")
    agg = _heat(days, cells, real).groupBy("user_id").agg(
        F.min_by(F.struct("day", "hour", "v"), F.struct(-v, F.col("dow"), F.col("hour_ord"))).alias("p"),
        micro_mean(F.when(v > 0, v)).alias("mean"),
    )
    return agg.select(
        "user_id", F.col("p.day").alias("day"), F.col("p.hour").alias("hour"), whole(F.col("p.v")).alias("value"),
        whole((F.col("p.v") - F.col("mean")) / F.col("mean") * 100.0).alias("vs_average"),
    )


# -- texts as codes ------------------------------------------------------------


def seasonality(sales: DataFrame) -> DataFrame:
    """Products with 70 % of their sales in one season, or in two adjacent ones."""
    season = labels.season_met(F.col("order_date"))
    sums = sales.groupBy("user_id", "product").agg(
        F.sum("quantity").alias("total"), *[F.sum(F.when(season == s, F.col("quantity"))).alias(s) for s in labels.SEASONS]
    )
    # four sums per product: sorting them is a row expression, not a window
    pairs = F.array_compact(F.array(*[
        F.when(F.col(s).isNotNull(), F.struct((-F.col(s)).alias("neg"), F.lit(s).alias("season"), F.lit(i).alias("ord")))
        for i, s in enumerate(labels.SEASONS)
    ]))
    by_size = sums.withColumn("o", F.sort_array(pairs)).withColumns({"a": F.get("o", F.lit(0)), "b": F.get("o", F.lit(1))})
    pct = lambda q: share(q, F.col("total")) * 100.0
    gap = F.abs(F.col("a.ord") - F.col("b.ord"))
    one, two = pct(-F.col("a.neg")), pct(-(F.col("a.neg") + F.col("b.neg")))
    two_ok = (two >= SEASONAL_PCT) & gap.isin(1, 3)
    first = F.when(F.col("a.ord") < F.col("b.ord"), F.col("a.season")).otherwise(F.col("b.season"))
    second = F.when(F.col("a.ord") < F.col("b.ord"), F.col("b.season")).otherwise(F.col("a.season"))
    label = F.when(one >= SEASONAL_PCT, F.col("a.season")).when(two_ok, F.concat(first, F.lit("–"), second))
    return by_size.select(
        "user_id", "product", label.alias("peak_seasons"),
        rnd(F.when(one >= SEASONAL_PCT, one).when(two_ok, two), 1).alias("concentration_pct"),
    ).filter(F.col("peak_seasons").isNotNull())


def tips(days: DataFrame) -> DataFrame:
    """Advice codes per workspace from level, peak day and events."""
    events = calendar.with_calendar(round_to_total(days, ["user_id"]), ["occasion"])
    occ = F.col("occasion")
    agg = events.groupBy("user_id").agg(
        (F.sum("units") / F.count("*")).alias("avg"), F.max("units").alias("peak"),
        F.bool_or(occ == "Ramadan").alias("ramadan"), F.bool_or(occ.startswith("Eid")).alias("eid"),
        F.bool_or(occ == "Saudi National Day").alias("national"), F.count_if(occ == "Weekend").alias("weekends"),
    )
    avg, some = F.col("avg"), F.col("avg") >= 1.0
    peak = F.when(F.col("peak") >= 20, "peak_high").when(F.col("peak") >= 5, "peak_mid").otherwise("peak_low")
    codes = F.array_compact(F.array(
        peak, F.when(some & F.col("ramadan"), "ramadan"), F.when(some & F.col("eid"), "eid"),
        F.when(some & F.col("national"), "national_day"),
        F.when(some & (F.col("weekends") >= 2) & (avg >= 3), "weekends"),
    ))
    return agg.select("user_id", F.explode(F.when(avg < 0.5, F.array(F.lit("low_demand"))).otherwise(codes)).alias("tip"))


def summary(days: DataFrame) -> DataFrame:
    """Average, peak, range, weekend lift, trend and the mean of each weekday of the menu total."""
    weekend = F.weekday("ds").isin(4, 5)
    mid = F.row_number().over(Window.partitionBy("user_id").orderBy("ds")) <= F.count("*").over(Window.partitionBy("user_id")) / 2
    v = F.col("yhat")
    agg = days.withColumn("early", mid).groupBy("user_id").agg(
        micro_mean(v).alias("avg"), F.min_by("ds", F.struct(-v, F.col("ds"))).alias("peak_ds"), F.min_by("ds", F.struct(v, F.col("ds"))).alias("low_ds"),
        F.max(v).alias("highest"), F.min(v).alias("lowest"),
        micro_mean(F.when(weekend, v)).alias("we"), micro_mean(F.when(~weekend, v)).alias("wd"),
        micro_mean(F.when(F.col("early"), v)).alias("a"), micro_mean(F.when(~F.col("early"), v)).alias("b"),
        *[rnd(micro_mean(F.when(labels.dow(F.col("ds")) == i, v))).alias(f"avg_{name.lower()}") for i, name in enumerate(labels.WEEKDAYS)],
    )
    return agg.select(
        "user_id", rnd(F.col("avg")).alias("avg_predicted"), "peak_ds", "low_ds", rnd(F.col("highest")).alias("highest"), rnd(F.col("lowest")).alias("lowest"),
        rnd(F.try_divide(F.col("we"), F.col("wd")) * 100.0 - 100.0, 1).alias("weekend_lift"),
        F.when(F.col("b") > F.col("a"), "up").when(F.col("b") < F.col("a"), "down").otherwise("flat").alias("trend"),
        *[f"avg_{name.lower()}" for name in labels.WEEKDAYS],
    )


def breakdown(totals: DataFrame, real: DataFrame, n_days: DataFrame) -> DataFrame:
    """Per category: predicted units, items, and the change of the daily mean
    against as many real days back from the last one, in %."""
    ends = real.groupBy("user_id").agg(F.max("order_date").alias("end")).join(n_days, "user_id")
    recent = real.join(ends, "user_id").filter(F.col("order_date") > F.date_sub("end", F.col("n_days").cast("int")))
    before = recent.groupBy("user_id", "category").agg(F.sum("quantity").alias("before"))
    ahead = totals.groupBy("user_id", "category").agg(micro_sum(F.col("total")).alias("predicted"), F.count("*").alias("item_count"))
    change = F.try_divide(F.col("predicted") - F.col("before"), F.col("before").cast("double")) * 100.0
    return ahead.join(before, ["user_id", "category"], "left").select(
        "user_id", "category", F.col("predicted").cast("bigint").alias("units"), "item_count", rnd(change, 1).alias("change_pct"))
