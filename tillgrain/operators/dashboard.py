"""Dashboard aggregations, one DataFrame per panel, all workspaces at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tillgrain.functions import labels
from tillgrain.functions.numeric import money, pct_change, rnd, share
from tillgrain.functions.ranking import ranked
from tillgrain.functions.tables import values
from tillgrain.operators import calendar


def line_cents() -> Column:
    return F.col("quantity") * F.col("price_cents")


def _by_order(sales: DataFrame, *keys: str) -> DataFrame:
    """Revenue and units per order: distinct order counts become plain counts
    on top of it, so one partial aggregation serves all measures."""
    return sales.groupBy("user_id", "order_date", *keys, "order_id").agg(
        F.sum(line_cents()).alias("rev"), F.sum("quantity").alias("units")
    )


def kpis(sales: DataFrame) -> DataFrame:
    """Revenue, orders, average order value and revenue per day of the span
    (last minus first day, not inclusive, at least 1)."""
    agg = _by_order(sales).groupBy("user_id").agg(
        F.sum("rev").alias("rev"),
        F.count("*").alias("total_orders"),
        F.greatest(F.datediff(F.max("order_date"), F.min("order_date")), F.lit(1)).alias("days"),
    )
    return agg.select(
        "user_id",
        money(F.col("rev")).alias("total_revenue"),
        "total_orders",
        rnd(money(F.col("rev")) / F.col("total_orders")).alias("avg_order_value"),
        rnd(money(F.col("rev")) / F.col("days")).alias("avg_daily_revenue"),
    )


def _windows(sales: DataFrame) -> DataFrame:
    """Last and previous 30 days in one pass, per workspace."""
    orders = _by_order(sales)
    bounds = orders.groupBy("user_id").agg(
        F.min("order_date").alias("first_ds"), F.max("order_date").alias("last_ds")
    )
    joined = orders.join(bounds, "user_id")
    age = F.datediff("last_ds", "order_date")
    cur, prev = age <= 29, age.between(30, 59)
    return joined.groupBy("user_id", "first_ds", "last_ds").agg(
        F.sum(F.when(cur, F.col("rev")).otherwise(0)).alias("cur_rev"),
        F.sum(F.when(prev, F.col("rev")).otherwise(0)).alias("prev_rev"),
        F.count_if(cur).alias("cur_orders"),
        F.count_if(prev).alias("prev_orders"),
        F.min(F.when(prev, F.col("order_date"))).alias("prev_first"),
    )


def _aov(rev: str, orders: str) -> Column:
    return F.coalesce(rnd(F.try_divide(money(F.col(rev)), F.col(orders).cast("double"))), F.lit(0.0))


def last30(sales: DataFrame) -> DataFrame:
    return _windows(sales).select(
        "user_id",
        F.date_sub("last_ds", 29).alias("window_start"),
        F.col("last_ds").alias("window_end"),
        money(F.col("cur_rev")).alias("revenue"),
        F.col("cur_orders").alias("orders"),
        _aov("cur_rev", "cur_orders").alias("avg_order_value"),
    )


def _delta(old: Column, new: Column) -> Column:
    return F.when(old > 0, pct_change(old, new)).otherwise(0.0)


def prev30_delta(sales: DataFrame) -> DataFrame:
    """Change against the 30 days before, 0 where there is no base."""
    w = _windows(sales)
    return w.select(
        "user_id",
        _delta(money(F.col("prev_rev")), money(F.col("cur_rev"))).alias("revenue_change"),
        _delta(F.col("prev_orders"), F.col("cur_orders")).alias("orders_change"),
        _delta(_aov("prev_rev", "prev_orders"), _aov("cur_rev", "cur_orders")).alias("avg_order_change"),
    )


def has_comparison(sales: DataFrame) -> DataFrame:
    return _windows(sales).select(
        "user_id",
        F.coalesce(
            (F.col("prev_first") >= F.col("first_ds")) & (F.col("prev_rev") > 0), F.lit(False)
        ).alias("has_comparison"),
    )


def product_totals(sales: DataFrame) -> DataFrame:
    """Revenue and units per product with its category. The lines are added up by
    product and category, which a hash aggregate can do; a text minimum over them
    would sort every line."""
    lines = sales.groupBy("user_id", "product", "category").agg(F.sum(line_cents()).alias("rev"), F.sum("quantity").alias("qty"))
    return lines.groupBy("user_id", "product").agg(F.min("category").alias("category"), F.sum("rev").alias("rev"), F.sum("qty").alias("qty"))


def best_seller(sales: DataFrame) -> DataFrame:
    """Product with the largest revenue, first name on ties."""
    top = F.min_by(F.struct("product", "qty"), F.struct(-F.col("rev"), F.col("product")))
    return product_totals(sales).groupBy("user_id").agg(top.alias("t")).select(
        "user_id", F.col("t.product").alias("product"), F.col("t.qty").alias("qty")
    )


def worst_seller(sales: DataFrame) -> DataFrame:
    low = F.min_by(F.struct("product", "qty"), F.struct("rev", "product"))
    return product_totals(sales).groupBy("user_id").agg(low.alias("t")).select(
        "user_id", F.col("t.product").alias("product"), F.col("t.qty").alias("qty")
    )


def daily_totals(sales: DataFrame) -> DataFrame:
    """Revenue, orders and units per day in cents."""
    return _by_order(sales).groupBy("user_id", "order_date").agg(
        F.sum("rev").alias("rev"), F.count("*").alias("orders"), F.sum("units").alias("units")
    )


def busiest_day(sales: DataFrame) -> DataFrame:
    """Weekday with the largest total and its average per date it occurred."""
    by_dow = (
        daily_totals(sales)
        .groupBy("user_id", labels.dow(F.col("order_date")).alias("dow"))
        .agg(
            F.sum("rev").alias("rev"),
            F.count("*").alias("dates"),
            F.first(labels.day_name(F.col("order_date"))).alias("day_name"),
        )
    )
    top = F.min_by(F.struct("day_name", "rev", "dates"), F.struct(-F.col("rev"), F.col("day_name")))
    return by_dow.groupBy("user_id").agg(top.alias("t")).select(
        "user_id",
        F.col("t.day_name").alias("day_name"),
        rnd(money(F.col("t.rev")) / F.col("t.dates"), 0).alias("avg_revenue"),
    )


def dow_stats(sales: DataFrame) -> DataFrame:
    """Orders, units and revenue per weekday that occurs in the date span,
    also where nothing was sold on it."""
    daily = daily_totals(sales)
    bounds = daily.groupBy("user_id").agg(
        F.min("order_date").alias("a"), F.max("order_date").alias("b")
    )
    present = bounds.select(
        "user_id",
        F.explode(F.sequence("a", F.least("b", F.date_add("a", 6)))).alias("ds"),
    ).select("user_id", labels.dow(F.col("ds")).alias("dow"), F.date_format("ds", "EEE").alias("name"))
    facts = daily.groupBy("user_id", labels.dow(F.col("order_date")).alias("dow")).agg(
        F.sum("orders").alias("o"), F.sum("units").alias("u"), F.sum("rev").alias("r")
    )
    return present.join(facts, ["user_id", "dow"], "left").select(
        "user_id", "dow", "name",
        F.coalesce("o", F.lit(0)).alias("orders"),
        F.coalesce("u", F.lit(0)).alias("units"),
        money(F.coalesce("r", F.lit(0))).alias("revenue"),
    )


def daily(sales: DataFrame) -> DataFrame:
    return daily_totals(sales).select(
        "user_id", "order_date", money(F.col("rev")).alias("revenue"), "orders"
    )


def monthly_growth(sales: DataFrame) -> DataFrame:
    """Monthly revenue and growth over the previous present month. The window
    runs over at most one row per workspace and month."""
    monthly = sales.groupBy("user_id", F.trunc("order_date", "month").alias("month")).agg(
        F.sum(line_cents()).alias("rev")
    )
    w = Window.partitionBy("user_id").orderBy("month")
    return monthly.withColumn("before", F.lag("rev").over(w)).select(
        "user_id",
        F.date_format("month", "yyyy-MM").alias("month"),
        money(F.col("rev")).alias("revenue"),
        F.coalesce(pct_change(F.col("before"), F.col("rev")), F.lit(0.0)).alias("growth"),
    )


def by_category(sales: DataFrame) -> DataFrame:
    return sales.groupBy("user_id", "category").agg(
        money(F.sum(line_cents())).alias("revenue"), F.sum("quantity").alias("units")
    )


def top_revenue(sales: DataFrame) -> DataFrame:
    return ranked(product_totals(sales), ["user_id"], "rev", "product").select(
        "user_id", "product", "category", money(F.col("rev")).alias("revenue"), "place"
    )


def top_qty(sales: DataFrame) -> DataFrame:
    return ranked(product_totals(sales), ["user_id"], "qty", "product").select(
        "user_id", "product", "category", "qty", "place"
    )


def dense_hours(users: DataFrame) -> DataFrame:
    """Every weekday x opening hour of every workspace (147 rows each)."""
    spark = users.sparkSession
    grid = values(
        spark,
        [(d, labels.WEEKDAYS[d][:3], h, i) for d in range(7) for i, h in enumerate(labels.OPEN_HOURS)],
        "dow int, day string, hour int, hour_ord int",
    )
    return users.crossJoin(F.broadcast(grid))


def heatmap(sales: DataFrame) -> DataFrame:
    """Line counts per weekday and opening hour, zero-filled."""
    cells = sales.groupBy("user_id", labels.dow(F.col("order_date")).alias("dow"), "hour").agg(
        F.count("*").alias("n")
    )
    users = sales.select("user_id").distinct()
    return dense_hours(users).join(cells, ["user_id", "dow", "hour"], "left").select(
        "user_id", "dow", "day", "hour", labels.hour_label(F.col("hour")).alias("hour_label"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("value"),
    )


def heatmap_norm(sales: DataFrame) -> DataFrame:
    """Cell value over the largest cell of the workspace, at most 1."""
    w = Window.partitionBy("user_id")
    top = F.greatest(F.max("value").over(w), F.lit(1))
    return heatmap(sales).withColumn(
        "intensity", rnd(F.least(F.col("value") / top, F.lit(1.0)), 6)
    ).select("user_id", "dow", "hour", "value", "intensity")


def category_list(sales: DataFrame) -> DataFrame:
    """'All' first, then the categories in name order."""
    names = sales.select("user_id", "category").distinct()
    every = names.select("user_id", F.lit("All").alias("category"), F.lit(0).alias("is_name")).distinct()
    both = every.unionByName(names.withColumn("is_name", F.lit(1)))
    w = Window.partitionBy("user_id").orderBy("is_name", "category")
    return both.select("user_id", "category", F.row_number().over(w).alias("place"))


def data_range(sales: DataFrame, as_of: str) -> DataFrame:
    """Span, row and order counts, and the window a forecast may ask for."""
    per_order = sales.groupBy("user_id", "order_id").agg(
        F.min("order_date").alias("a"), F.max("order_date").alias("b"), F.count("*").alias("n")
    )
    agg = per_order.groupBy("user_id").agg(
        F.min("a").alias("earliest"), F.max("b").alias("latest"),
        F.sum("n").alias("total_rows"), F.count("*").alias("unique_orders"),
    )
    total = F.datediff("latest", "earliest") + 1
    start = F.date_add(F.greatest(F.lit(as_of).cast("date"), F.col("latest")), 1)
    cap = F.greatest(F.lit(1825), total * 5)
    return agg.select(
        "user_id", "earliest", "latest", total.cast("bigint").alias("total_days"), "total_rows", "unique_orders",
        start.alias("forecast_start"), F.date_add(start, cap).alias("forecast_end_max"),
        cap.cast("bigint").alias("forecast_max_days"),
        F.greatest(F.lit(7), F.floor(total * 0.3)).cast("bigint").alias("reliable_days"),
        total.cast("bigint").alias("directional_days"),
    )


def reliability(sales: DataFrame, as_of: str, horizons: tuple[int, ...] = (7, 30, 90, 365, 730, 1095, 3650)) -> DataFrame:
    """Tier of each horizon against the length of the history."""
    spark = sales.sparkSession
    h = values(spark, [(v,) for v in horizons], "horizon int")
    tier = (
        F.when(F.col("horizon") <= F.col("reliable_days"), "reliable")
        .when(F.col("horizon") <= F.col("directional_days"), "directional")
        .otherwise("extrapolation")
    )
    return data_range(sales, as_of).crossJoin(F.broadcast(h)).select("user_id", "horizon", tier.alias("tier"))


def products(sales: DataFrame, category: str | None = None) -> DataFrame:
    if category and category.lower() != "all":
        sales = sales.filter(F.col("category") == category)
    return product_totals(sales).select(
        "user_id", "product", "category", "qty", money(F.col("rev")).alias("revenue")
    )


def rollup(sales: DataFrame, start: str, end: str) -> DataFrame:
    """The chosen range again from the daily table: averages over the days
    present, and the growth of the last month in range."""
    days = daily_totals(sales).filter(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    growth = (
        monthly_growth(sales)
        .filter(F.col("month").between(start[:7], end[:7]))
        .groupBy("user_id")
        .agg(F.max_by("growth", "month").alias("last_growth"))
    )
    agg = days.groupBy("user_id").agg(
        F.sum("rev").alias("rev"), F.sum("orders").alias("orders"), F.count("*").alias("days")
    )
    return agg.join(growth, "user_id", "left").select(
        "user_id", money(F.col("rev")).alias("revenue"), "orders",
        rnd(money(F.col("rev")) / F.col("orders")).alias("avg_order_value"),
        rnd(money(F.col("rev")) / F.col("days")).alias("avg_daily_revenue"),
        F.coalesce("last_growth", F.lit(0.0)).alias("last_growth"),
    )


def special_days(sales: DataFrame) -> DataFrame:
    """Average revenue of each occasion against the normal-day average, with
    the workspace's peak day and the event nearest to it."""
    days = calendar.with_calendar(
        daily_totals(sales).select("user_id", F.col("order_date").alias("ds"), "rev"), ["occasion"]
    )
    by_occ = days.groupBy("user_id", "occasion").agg(F.sum("rev").alias("rev"), F.count("*").alias("days"))
    mean = money(F.col("rev")) / F.col("days")
    normal = by_occ.filter(F.col("occasion") == "Normal Day").select("user_id", mean.alias("normal"))
    peak = days.groupBy("user_id").agg(F.min_by("ds", F.struct(-F.col("rev"), F.col("ds"))).alias("peak_ds"))
    # the events before and after every calendar day; the calendar has a fixed number of days
    is_event = F.col("occasion").isin("Ramadan", "Eid al-Fitr", "Eid al-Adha", "Saudi National Day", "Saudi Founding Day")
    event = F.when(is_event, F.struct(F.col("occasion").alias("event"), F.col("ds").alias("event_ds")))
    by_day = Window.orderBy("ds")
    around = calendar.calendar(sales.sparkSession).select(
        F.col("ds").alias("peak_ds"),
        F.last(event, ignorenulls=True).over(by_day).alias("past"),
        F.first(event, ignorenulls=True).over(by_day.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("coming"),
    )
    ahead = F.datediff("coming.event_ds", "peak_ds") < F.datediff("peak_ds", "past.event_ds")
    near = F.when(F.col("past").isNull() | ahead, F.col("coming")).otherwise(F.col("past"))
    nearest = peak.join(F.broadcast(around), "peak_ds", "left").select(
        "user_id", "peak_ds", near["event"].alias("peak_event"),
        F.datediff(near["event_ds"], "peak_ds").cast("int").alias("peak_event_in_days"),
    )
    return (
        by_occ.join(normal, "user_id", "left").join(nearest, "user_id", "left")
        .select(
            "user_id", "occasion", F.col("days"), rnd(mean).alias("avg_revenue"),
            pct_change(F.col("normal"), mean).alias("lift_pct"),
            "peak_ds", "peak_event", "peak_event_in_days",
        )
    )
