"""Registered queries: forecast evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillgrain.functions import labels
from tillgrain.functions.numeric import micro_sum, rnd
from tillgrain.operators import calendar, cleaning as cln, evaluate as ev, factored, fit, forecast as fc, menu, views
from tillgrain.plans import forecast as pf, ingest, menu as pm
from tillgrain.plans import facts
from tillgrain.plans.facts import real, real_hours, real_units, with_lines
from tillgrain.plans.params import AS_OF, NEAR, PERIOD
from tillgrain.session import once, through_table

FOLDS = [("F1", "1999-06-30", 31), ("F2", "1999-12-31", 31), ("F3", "2000-06-30", 30), ("F4", "2000-12-31", 31), ("F5", "2001-06-30", 28)]
TRAIN_END, TEST_END, TEST_DAYS = "2000-12-31", "2001-03-31", 90
# Dates with the label and payday flag they must have, and dates
# whose model parts are shown (fast, its last day, feast and days after, payday
# and after, second feast, national day, an ordinary weekday and Friday).
SPOTS = [("2022-07-27", "Payday", True), ("2022-05-02", "Eid al-Fitr", True), ("2022-04-15", "Ramadan", False), ("2022-09-23", "National Day", False),
         ("2022-02-22", "Founding", False), ("2022-08-15", "Normal", False), ("2022-07-09", "Eid al-Adha", False), ("2022-05-30", "Post-payday", True)]
SAMPLE_DATES = ["2000-12-10", "2000-12-26", "2000-12-27", "2000-12-29", "2000-07-27", "2000-07-30", "2001-03-07", "2000-09-23", "2000-10-11", "2000-10-13"]


def real_daily(spark: SparkSession, d: str) -> DataFrame:
    return fc.daily(real_hours(spark, d)).select("user_id", "ds", "y")


def models() -> list[fit.Model]:
    """Every model of the evaluation: all are fitted in one pass over the days."""
    out = [fit.Model(name + suffix, cutoff, robust=not suffix, days="after", horizon=n) for name, cutoff, n in FOLDS for suffix in ("", "-all")]
    last, horizon = FOLDS[-1][1:]
    out += [fit.Model(f"no_{block}", last, drop=block, days="after", horizon=horizon) for block in ("holidays", "weather", "seasons")]
    return [*out, fit.Model("pattern", TRAIN_END, days="after", horizon=TEST_DAYS)]


def fits(spark: SparkSession, d: str) -> DataFrame:
    done = fit.fit(pf.daily(spark, d), ["user_id"], pf.design(spark, d), models())
    return once(("fold-fits", d), lambda: through_table(done.select("user_id", "model", "ds", "yhat"), "fold-fits"))


def folds(spark: SparkSession, d: str) -> DataFrame:
    return ev.folds(pf.daily(spark, d).select("user_id", "ds", "y"), fits(spark, d), real_daily(spark, d), FOLDS)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return through_table(ev.real_days(folds(spark, d)), "scored")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return once(("first-seen", d), lambda: through_table(ev.first_seen(pf.rows(spark, d), FOLDS), "fold-cells"))


def fold_cells(spark: SparkSession, d: str) -> DataFrame:
    return ev.fold_cells(first_seen(spark, d), FOLDS)


def source(spark: SparkSession, d: str) -> DataFrame:
    """Curated rows: bad dates dropped, quantities coerced, labels attached."""
    rows = cln.normalised(ingest.fields(spark, d)).withColumn("ds", F.to_date("order_datetime")).filter(F.col("ds").isNotNull())
    return calendar.with_calendar(rows.select("user_id", "sku", "ds", "quantity", "is_imputed"), ["season", "occasion", "dow"])


def categories(spark: SparkSession, d: str) -> DataFrame:
    return facts.lines(spark, d).groupBy("user_id", "product").agg(F.min("category").alias("category"))


def by_category(spark: SparkSession, d: str) -> DataFrame:
    """Category forecast of the model, real actuals and 28-day baseline over the test window."""
    keys = ("user_id", "category")
    end = F.lit(TRAIN_END).cast("date")
    known = through_table(fc.cells(pf.rows(spark, d).filter(F.col("order_date") <= end)), "pattern-cells")
    daily = fits(spark, d).filter(F.col("model") == "pattern").select("user_id", "ds", "yhat").join(known.select("user_id").distinct(), "user_id", "left_semi")
    forecast = factored.by_day(daily, known, {"yhat": F.lit(1.0)}, ["category"], categories(spark, d))
    real_days = fc.daily(real(spark, d), keys)
    base = ev.naive28(real_days.filter(F.col("ds") <= end), forecast.select(*keys, "ds"), keys).withColumnRenamed("yhat", "naive")
    return forecast.join(base, [*keys, "ds"]).join(real_days.select(*keys, "ds", "y"), [*keys, "ds"], "left")


def pattern(spark: SparkSession, d: str) -> DataFrame:
    return ev.pattern(through_table(by_category(spark, d), "pattern"), ["user_id", "category"])


def near(spark: SparkSession, d: str) -> DataFrame:
    """The model's next NEAR days, as the validation looks at them."""
    days = pf.fitted_total(spark, d).join(pf.data_end(spark, d), "user_id")
    ahead = days.filter((F.col("ds") > F.col("data_end")) & (F.col("ds") <= F.date_add("data_end", NEAR)))
    return once(("near", d), lambda: through_table(ahead.select("user_id", "ds", "yhat"), "near"))


def heat_pair(spark: SparkSession, d: str) -> DataFrame:
    """Forecast heat next to the real heat: all 168 cells, closed hours being 0 ahead."""
    heat = views.heatmap_values(near(spark, d), pf.cells(spark, d), real_hours(spark, d))
    cells = ev.real_heatmap(real_hours(spark, d)).withColumnRenamed("units_per_day", "real")
    return cells.join(heat, ["user_id", "dow", "hour"], "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))


def near_money(spark: SparkSession, d: str, extra: list[str]) -> DataFrame:
    items = views.priced(menu.items(facts.lines(spark, d)))
    return factored.by_day(near(spark, d), pf.cells(spark, d), views.money_of("revenue"), extra, items)


def dow_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Revenue per occurrence of each weekday: predicted and real."""
    dow = labels.dow(F.col("ds")).alias("dow")
    pred = near_money(spark, d, []).groupBy("user_id", dow).agg((micro_sum(F.col("revenue"), 4) / F.count("*")).alias("pred"))
    r = real(spark, d).groupBy("user_id", F.col("order_date").alias("ds")).agg(F.sum(F.col("quantity") * F.col("price_cents")).alias("c"))
    truth = r.groupBy("user_id", dow).agg((F.sum("c") / 100.0 / F.count("*")).alias("real"))
    return pred.join(truth, ["user_id", "dow"], "left").withColumn("real", F.coalesce("real", F.lit(0.0)))


def category_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Category revenue: predicted, and real over as many last days."""
    pred = near_money(spark, d, ["category"]).groupBy("user_id", "category").agg(micro_sum(F.col("revenue"), 4).alias("pred"))
    r = real(spark, d)
    ends = r.groupBy("user_id").agg(F.max("order_date").alias("end"))
    recent = r.join(ends, "user_id").filter(F.col("order_date") > F.date_sub("end", NEAR))
    truth = recent.groupBy("user_id", "category").agg((F.sum(F.col("quantity") * F.col("price_cents")) / 100.0).alias("real"))
    return pred.join(truth, ["user_id", "category"])


def level(spark: SparkSession, d: str) -> DataFrame:
    return ev.level(near(spark, d), real_daily(spark, d))


def ablation(spark: SparkSession, d: str) -> DataFrame:
    """The last fold without one block of features at a time, next to the full
    model and the weekday mean, per workspace."""
    fold = FOLDS[-1][0]
    done = fits(spark, d)
    variant = F.when(F.col("model") == f"{fold}-all", "full").otherwise(F.col("model"))
    rows = done.withColumn("variant", variant).filter(F.col("variant").isin("full", "no_holidays", "no_weather", "no_seasons"))
    truth = real_daily(spark, d).select("user_id", "ds", F.col("y").alias("y_real"))
    known = pf.daily(spark, d).filter(F.col("ds") <= F.lit(FOLDS[-1][1]).cast("date")).select("user_id").distinct()
    base = ev.naive_dow(pf.daily(spark, d).filter(F.col("ds") <= F.lit(FOLDS[-1][1]).cast("date")), rows.filter(F.col("variant") == "full").select("user_id", "ds"))
    both = rows.select("user_id", "variant", "ds", "yhat").unionByName(base.select("user_id", F.lit("naive_dow").alias("variant"), "ds", "yhat"))
    both = both.join(known, "user_id", "left_semi").join(truth, ["user_id", "ds"])
    return ev.metrics(both, ["user_id", "variant"], "yhat", "y_real").select("user_id", "variant", "n", "mae", "wape")


def gates(spark: SparkSession, d: str) -> DataFrame:
    # the small scores are stored, because several gates read each of them
    heat = through_table(ev.cell_agreement(heat_pair(spark, d)), "gate-heat")
    dow = through_table(ev.rank_agreement(ev.ranked_pairs(dow_pairs(spark, d), "dow"), "dow", 2), "gate-dow")
    cat = through_table(ev.rank_agreement(ev.ranked_pairs(category_pairs(spark, d), "category"), "category", 3), "gate-category")
    mae = lambda v: F.max(F.when(F.col("variant") == v, F.col("mae")))
    beats = ablation(spark, d).groupBy("user_id").agg((mae("full") < mae("naive_dow")).alias("ok"))
    parts = ev.components(pf.fitted_total(spark, d))
    active = F.lit(True)
    for part in ev.PARTS:
        active = active & F.col(f"{part}_active")
    spots = ev.spot_checks(spark, SPOTS).agg(F.bool_and("passed").alias("ok"))
    test = lambda df, c: df.select("user_id", c.alias("passed"))
    return ev.gates({
        "heatmap_pearson": test(heat, F.col("pearson") >= 0.85), "heatmap_top5_jaccard": test(heat, F.col("top5_jaccard") >= 0.6),
        "daily_level": test(level(spark, d), F.col("passed")), "dow_spearman": test(dow, F.col("spearman") >= 0.7),
        "category_jaccard": test(cat, F.col("jaccard") >= 0.66), "category_spearman": test(cat, F.col("spearman") >= 0.6),
        "ablation_full_beats_baseline": test(beats, F.col("ok")), "date_spot_checks": test(parts.select("user_id").crossJoin(F.broadcast(spots)), F.col("ok")),
        "components_active": test(parts, active),
    })


def renorm(spark: SparkSession, d: str) -> DataFrame:
    days = pf.service(spark, d)
    cells = factored.by_day(days, pf.cells(spark, d), {"yhat": F.lit(1.0)}, ["category", "time_period"], categories(spark, d))
    return ev.renormalised(cells, fc.round_to_total(days, ["user_id"]), ["user_id", "ds", "category", "time_period"])


def menu_hist(spark: SparkSession, d: str) -> DataFrame:
    """40-bin histograms of the items' margin and popularity."""
    items = through_table(menu.classified(pm.table(spark, d)), "hist-items")
    one = lambda c: ev.histogram(items, rnd(F.col(c), 6), 40, ["user_id"]).withColumn("measure", F.lit(c))
    return one("margin").unionByName(one("popularity"))


def pearson(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("user_id").agg(rnd(ev.safe_corr(F.col("yhat"), F.col("y")), 4).alias("pearson"))


def mapd(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("user_id").agg(rnd(ev.mapd("yhat", "naive_mean"), 3).alias("mapd"))


def naive28(spark: SparkSession, d: str) -> DataFrame:
    r = real_daily(spark, d)
    return ev.naive28(r, fc.future_days(pf.daily(spark, d), AS_OF, PERIOD)).select("user_id", "ds", "yhat")


def sliced(spark: SparkSession, d: str) -> DataFrame:
    rows, cells, r = scored(spark, d), fold_cells(spark, d), real_units(spark, d)
    sold = ev.fold_cells(ev.sold_cells(rows, first_seen(spark, d), r), FOLDS, ("sold",))
    return ev.sliced(rows, ev.period_rows(rows, cells, r), ev.product_metrics(rows, cells, sold))


U = ["user_id"]
QUERIES = {
    "ev_source": source,
    "ev_folds": folds,
    "ev_real_days": lambda s, d: scored(s, d).select("user_id", "fold", "ds", "y", "yhat", "occasion", "occ_family", "month"),
    "ev_metrics": lambda s, d: ev.metrics(scored(s, d), U),
    "ev_slice": sliced,
    "ev_horizon_bucket": lambda s, d: scored(s, d).select("user_id", "fold", "ds", "horizon_day", "horizon_bucket"),
    "ev_model_compare": lambda s, d: ev.model_compare(scored(s, d)),
    "ev_inflation": lambda s, d: ev.inflation(scored(s, d), factored.slot_total(fold_cells(s, d), ev.UF)),
    "ev_worst_days": lambda s, d: ev.worst_days(scored(s, d)),
    "ev_residual_hist": lambda s, d: ev.histogram(scored(s, d), rnd(F.col("yhat") - F.col("y"), 6), 30, U),
    "ev_menu_hist": menu_hist,
    "ev_renorm": with_lines(renorm),
    "ev_cells": lambda s, d: ev.cell_totals(scored(s, d), fold_cells(s, d), real_units(s, d)),
    "ev_top_products": lambda s, d: ev.metrics(ev.top_product_rows(scored(s, d), fold_cells(s, d), real_units(s, d)), ["user_id", "product"]),
    "ev_pearson": pearson,
    "ev_autocorr": lambda s, d: ev.autocorr(real_daily(s, d), U, "y", 7),
    "ev_weekday_strength": lambda s, d: ev.weekday_strength(real_daily(s, d), U, "y"),
    "ev_fft7": lambda s, d: ev.fft7(real_daily(s, d), U, "y"),
    "ev_spearman": lambda s, d: ev.spearman(ev.weekday_means(scored(s, d), U), U, "fc_mean", "ac_mean"),
    "ev_naive28": naive28,
    "ev_mapd": mapd,
    "ev_pattern": with_lines(pattern),
    "ev_grade": with_lines(lambda s, d: ev.graded(pattern(s, d)).select("user_id", "category", "pattern_score", "replication_score", "grade")),
    "ev_real_heatmap": lambda s, d: ev.real_heatmap(real_units(s, d)),
    "ev_top_cells": lambda s, d: ev.cell_agreement(heat_pair(s, d)),
    "ev_level": level,
    "ev_dow_rank": with_lines(lambda s, d: ev.ranked_pairs(dow_pairs(s, d), "dow")),
    "ev_category_rank": with_lines(lambda s, d: ev.ranked_pairs(category_pairs(s, d), "category")),
    "ev_components": lambda s, d: ev.components(pf.fitted_total(s, d)),
    "ev_component_sample": lambda s, d: ev.component_sample(pf.fitted_total(s, d), SAMPLE_DATES),
    "ev_ablation": ablation,
    "ev_gates": with_lines(gates),
}
