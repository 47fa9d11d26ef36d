"""Product matrix: popularity x margin classes and the checks around them.

Every function takes the item table (one row per workspace and product). It is
the only thing built from the fact table; callers that use it more than once
store it with ``item_table``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tillgrain.functions import labels, rules
from tillgrain.functions.numeric import micro_mean, micro_sum, money, pct_change, rnd, share
from tillgrain.functions.ranking import median
from tillgrain.functions.tables import values
from tillgrain.session import through_table

POPULARITY_FACTOR = 0.7


def order_key() -> Column:
    """Date, order and line as one number, so that the earliest line is a plain
    minimum: a fixed-width value that a hash aggregate can hold."""
    days = F.coalesce(F.datediff("order_date", F.lit("1900-01-01").cast("date")), F.lit(999_999)).cast("decimal(7,0)")
    place = F.col("order_id").cast("decimal(19,0)") * F.lit(Decimal(10**5))
    return days * F.lit(Decimal(10**24)) + place + F.col("line_no").cast("decimal(10,0)")


def items(sales: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Totals per product; category, price and cost of the earliest line.

    The lines are added up by product and price first, with the earliest place of
    each price; what is left per product are its few prices."""
    by = [*keys, "product"]
    prices = sales.groupBy(*by, "category", "price_cents", "cost_cents").agg(
        F.sum("quantity").alias("qty"), F.min(order_key()).alias("first"))
    agg = prices.groupBy(*by).agg(
        F.min_by(F.struct("category", "price_cents", "cost_cents"), F.struct("first", "price_cents", "cost_cents")).alias("f"),
        F.sum("qty").alias("qty"),
        F.sum(F.col("qty") * F.col("price_cents")).alias("rev_cents"),
        F.sum(F.col("qty") * F.col("cost_cents")).alias("total_cost_cents"),
    )
    profit = F.col("rev_cents") - F.col("total_cost_cents")
    return agg.select(
        *keys, "product",
        F.col("f.category").alias("category"),
        "qty",
        money(F.col("f.price_cents")).alias("price"),
        money(F.col("f.cost_cents")).alias("cost"),
        money(F.col("rev_cents")).alias("revenue"),
        money(F.col("total_cost_cents")).alias("total_cost"),
        money(profit).alias("profit"),
        F.coalesce(share(profit, F.col("rev_cents")) * 100.0, F.lit(0.0)).alias("margin"),
    )


def first_prices(sales: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """The price of ``items`` alone: that of a product's earliest line. Lines are
    dealt by product, like ``forecast.cells``, so a join with that finds both in place."""
    by = [*keys, "product"]
    lines = sales.select(*by, "price_cents", order_key().alias("place")).repartition(*by)
    prices = lines.groupBy(*by, "price_cents").agg(F.min("place").alias("first"))
    return prices.groupBy(*by).agg(money(F.min_by("price_cents", F.struct("first", "price_cents"))).alias("price"))


def with_rules(items: DataFrame) -> DataFrame:
    """Elasticity and cost cap of the item's category."""
    return items.withColumns({
        "elasticity": rules.elasticity(F.col("category"))["value"],
        "cost_cap": rules.cost_cap(F.col("category"))["value"],
    })


def item_table(sales: DataFrame) -> DataFrame:
    """Items with their category rules as a stored table, read by every branch
    of a pricing job; filters on later results stop at this table instead of
    dragging the rule lookup along."""
    return through_table(with_rules(items(sales)), "items")


def thresholds(items: DataFrame, factor: float = POPULARITY_FACTOR, keys: tuple[str, ...] = ("user_id",), margin: str = "margin") -> DataFrame:
    """Cutoffs per workspace. The mean of the popularity shares is 100 / items,
    so only the count is needed; the margin mean is over items, unweighted."""
    n = F.count("*")
    return items.groupBy(*keys).agg(
        n.alias("n_items"),
        F.sum("qty").alias("total_qty"),
        (F.lit(factor * 100.0) / n).alias("pop_cut"),
        micro_mean(F.col(margin)).alias("margin_cut"),
    )


def quadrant(popularity: Column, margin: Column, pop_cut: Column, margin_cut: Column) -> Column:
    popular, profitable = popularity >= pop_cut, margin >= margin_cut
    return (
        F.when(popular & profitable, "Star")
        .when(popular, "Plowhorse")
        .when(profitable, "Puzzle")
        .otherwise("Dog")
    )


def classified(items: DataFrame, factor: float = POPULARITY_FACTOR, keys: tuple[str, ...] = ("user_id",), margin: str = "margin") -> DataFrame:
    """Items with cutoffs, popularity and class. The cutoff table has one row
    per workspace and is joined back, so no window ever holds a workspace."""
    cut = thresholds(items, factor, keys, margin)
    return (
        items.join(cut, list(keys))
        .withColumn("popularity", share(F.col("qty"), F.col("total_qty")) * 100.0)
        .withColumn("classification", quadrant(F.col("popularity"), F.col(margin), F.col("pop_cut"), F.col("margin_cut")))
    )


def popularity(items: DataFrame) -> DataFrame:
    return classified(items).select("user_id", "product", "qty", rnd(F.col("popularity"), 6).alias("popularity"))


def item_report(items: DataFrame) -> DataFrame:
    return items.select(
        "user_id", "product", "category", "qty", "price", "cost", "revenue", "total_cost", "profit",
        rnd(F.col("margin")).alias("margin"),
    )


def class_report(items: DataFrame) -> DataFrame:
    return classified(items).select(
        "user_id", "product", "category", "qty", "revenue", "profit",
        rnd(F.col("margin")).alias("margin"), rnd(F.col("popularity"), 6).alias("popularity"), "classification",
    )


def quadrants(items: DataFrame) -> DataFrame:
    """Count and revenue of all four classes with their items in long form,
    one row per item (one row without item for an empty class)."""
    spark = items.sparkSession
    done = classified(items)
    classes = values(spark, [(c,) for c in labels.CLASSES], "classification string")
    frame = items.select("user_id").distinct().crossJoin(F.broadcast(classes))
    totals = done.groupBy("user_id", "classification").agg(
        F.count("*").alias("n"), micro_sum(F.col("revenue"), 4).alias("rev")
    )
    members = done.select("user_id", "classification", "product")
    return (
        frame.join(totals, ["user_id", "classification"], "left")
        .join(members, ["user_id", "classification"], "left")
        .select(
            "user_id", "classification",
            F.coalesce("n", F.lit(0)).alias("item_count"),
            F.coalesce("rev", F.lit(0.0)).alias("class_revenue"),
            "product",
        )
    )


def price_margin(items: DataFrame) -> DataFrame:
    """Margin from current price and cost instead of from sold lines."""
    return items.withColumn("price_margin", F.coalesce(F.try_divide(F.col("price") - F.col("cost"), F.col("price")) * 100.0, F.lit(0.0)))


def classify_mean(items: DataFrame) -> DataFrame:
    """Variant with plain mean cutoffs and the price-based margin."""
    return classified(price_margin(items), 1.0, margin="price_margin").select(
        "user_id", "product", rnd(F.col("popularity"), 6).alias("popularity"),
        rnd(F.col("price_margin")).alias("margin"), "classification",
    )


def snapshot(sales: DataFrame) -> DataFrame:
    """Metric snapshot per product and calendar month, cutoffs per month."""
    keys = ("user_id", "period_start")
    monthly = items(sales.withColumn("period_start", F.trunc("order_date", "month")), keys)
    return classified(through_table(monthly, "snapshot"), keys=keys).select(
        "user_id", "product", "period_start", F.last_day("period_start").alias("period_end"),
        F.col("qty").alias("total_qty"), F.col("revenue").alias("total_revenue"), "total_cost",
        F.col("profit").alias("contribution_margin"), rnd(F.col("margin")).alias("margin_pct"),
        rnd(F.col("popularity")).alias("popularity_score"), "classification",
    )


def quadrant_share(items: DataFrame) -> DataFrame:
    """Share of items and revenue per class with its medians."""
    done = through_table(classified(items, 1.0), "classified")
    keys = ["user_id", "classification"]
    totals = done.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), micro_sum(F.col("revenue"), 4).alias("revenue"))
    menu = totals.groupBy("user_id").agg(F.sum("n").alias("all_n"), micro_sum(F.col("revenue"), 4).alias("all_rev"))
    pop = median(done, keys, "popularity", "product", "med_popularity")
    mar = median(done, keys, "margin", "product", "med_margin")
    return (
        totals.join(menu, "user_id").join(pop, keys).join(mar, keys)
        .select(
            *keys, F.col("n").alias("item_count"), "qty", "revenue",
            rnd(F.col("n") / F.col("all_n") * 100.0, 1).alias("count_share"),
            rnd(F.col("revenue") / F.col("all_rev") * 100.0, 1).alias("revenue_share"),
            rnd(F.col("med_popularity"), 4).alias("med_popularity"), rnd(F.col("med_margin"), 4).alias("med_margin"),
        )
    )


def cutoff_flips(items: DataFrame) -> DataFrame:
    """Items whose class changes when medians replace the mean cutoffs."""
    done = through_table(classified(items, 1.0), "classified")
    pop = median(done, ["user_id"], "popularity", "product", "med_pop")
    mar = median(done, ["user_id"], "margin", "product", "med_mar")
    other = quadrant(F.col("popularity"), F.col("margin"), F.col("med_pop"), F.col("med_mar"))
    return (
        done.join(pop, "user_id").join(mar, "user_id")
        .withColumn("by_median", other)
        .filter(F.col("classification") != F.col("by_median"))
        .select("user_id", "product", F.col("classification").alias("by_mean"), "by_median")
    )


def boundary(items: DataFrame, pop_band: float = 0.20, margin_band: float = 2.0) -> DataFrame:
    """Items close to one of the cutoffs, in percentage points."""
    pop = rnd(F.col("popularity") - F.col("pop_cut"), 4)
    mar = rnd(F.col("margin") - F.col("margin_cut"), 4)
    return (
        classified(items, 1.0)
        .select("user_id", "product", "classification", pop.alias("pop_dist"), mar.alias("margin_dist"))
        .filter((F.abs("pop_dist") <= pop_band) | (F.abs("margin_dist") <= margin_band))
    )


def elasticity_coverage(items: DataFrame) -> DataFrame:
    """Items, elasticity and kind of match per category. The rule is looked up
    once per category, after the aggregation."""
    e = rules.elasticity(F.col("category"))
    return items.groupBy("user_id", "category").agg(F.count("*").alias("n_items")).select(
        "user_id", "category", "n_items", e["value"].alias("elasticity"), e["source"].alias("source")
    )


def imputed_drift(sales: DataFrame) -> DataFrame:
    """Items whose class differs once imputed rows are mixed in. One pass over
    the facts builds both item totals; the two matrices share the stored table."""
    measures = {"qty": F.col("quantity"), "rev": F.col("quantity") * F.col("price_cents"), "cst": F.col("quantity") * F.col("cost_cents")}
    real = ~F.col("is_imputed")
    agg = sales.groupBy("user_id", "product").agg(
        *[F.sum(v).alias(f"all_{k}") for k, v in measures.items()],
        *[F.sum(F.when(real, v)).alias(f"real_{k}") for k, v in measures.items()],
    )
    both = through_table(agg, "drift")

    def matrix(prefix: str, name: str) -> DataFrame:
        rev, cst = F.col(f"{prefix}_rev"), F.col(f"{prefix}_cst")
        side = both.filter(rev.isNotNull()).select(
            "user_id", "product", F.col(f"{prefix}_qty").alias("qty"),
            F.coalesce(share(rev - cst, rev) * 100.0, F.lit(0.0)).alias("margin"),
        )
        return classified(side, 1.0).select("user_id", "product", F.col("classification").alias(name))

    shares = both.groupBy("user_id").agg(
        rnd(share(F.sum(F.coalesce("real_qty", F.lit(0))), F.sum("all_qty")), 3).alias("real_share")
    )
    return (
        matrix("real", "real_only").join(matrix("all", "with_imputed"), ["user_id", "product"])
        .filter(F.col("real_only") != F.col("with_imputed"))
        .join(shares, "user_id")
    )


def textbook_check(items: DataFrame, deltas: tuple[int, ...] = (-20, -10, 10, 20, 30)) -> DataFrame:
    """Projection against the closed form for each price step."""
    from tillgrain.operators.pricing import project_qty

    steps = values(items.sparkSession, [(d,) for d in deltas], "delta_pct int")
    grid = items.crossJoin(F.broadcast(steps))
    factor = 1.0 + F.col("delta_pct") / 100.0
    ours = project_qty(F.col("qty"), F.col("price"), F.col("price") * factor, F.col("elasticity"))
    book = F.col("qty") * F.pow(factor, F.col("elasticity"))
    return grid.select(
        "user_id", "product", "delta_pct", "elasticity",
        rnd(ours, 4).alias("projected_qty"), rnd(book, 4).alias("closed_form_qty"),
        rnd(F.abs(ours - book), 6).alias("abs_diff"),
    )
