"""Forecast evaluation: rolling folds, error metrics and pattern measures.

Frames here hold one row per day (or day and category) and series, so windows
are bounded by the calendar.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from tillgrain.functions import labels
from tillgrain.functions.numeric import MICRO, micro_mean, micro_sum, rnd, share, whole
from tillgrain.functions.ranking import top_k
from tillgrain.functions.tables import values
from tillgrain.operators import calendar, factored, grid
from tillgrain.operators.forecast import QTY, dealt, in_period, naive_dow
from tillgrain.session import through_table

TINY = 1e-9


UF = ["user_id", "fold"]
MODELS = ("raw", "floored", "cells", "service", "naive_dow", "naive_mean")
#: the forecast that slices and pattern measures look at
HEADLINE = "floored"


def plan_table(history: DataFrame, plan: list[tuple[str, str, int]]) -> DataFrame:
    f = values(history.sparkSession, plan, "fold string, cutoff string, horizon int")
    return f.withColumn("cutoff", F.col("cutoff").cast("date"))


def folds(history: DataFrame, fitted: DataFrame, real: DataFrame, plan: list[tuple[str, str, int]]) -> DataFrame:
    """Rolling origins in one job: what each model says about the days after a
    cutoff. ``history`` is (user_id, ds, y), ``real`` the same of real rows only,
    ``fitted`` the model's values (user_id, model, ds, yhat) where ``<fold>`` has
    learned without partial days and ``<fold>-all`` from all days.

    raw is the model, floored lifts it to the 25th percentile of the weekday,
    cells is what the shares split up, service brings that to the historical level.
    """
    train = history.crossJoin(F.broadcast(plan_table(history, plan))).filter(F.col("ds") <= F.col("cutoff"))
    span = F.datediff(F.max("ds"), F.min("ds")) + 1
    known = train.groupBy(*UF, "cutoff", "horizon").agg((F.sum("y") / span).alias("per_day"), rnd(micro_mean(F.col("y")), 6).alias("naive_mean"))
    ahead = known.select(
        *UF, "cutoff", "per_day", "naive_mean",
        F.explode(F.sequence(F.date_add("cutoff", 1), F.date_add(F.col("cutoff"), F.col("horizon")))).alias("ds")
    )
    by_dow = train.withColumn("dow", labels.dow(F.col("ds")))
    usual = by_dow.groupBy(*UF, "dow").agg(F.median("y").alias("usual"))
    floor = by_dow.join(usual, [*UF, "dow"]).filter(F.col("y") >= F.col("usual") * 0.3).groupBy(*UF, "dow").agg(F.percentile("y", 0.25).alias("p25"))
    raw = fitted.select("user_id", F.col("model").alias("fold"), "ds", F.col("yhat").alias("raw"))
    every = fitted.filter(F.col("model").endswith("-all")).select("user_id", F.regexp_replace("model", "-all$", "").alias("fold"), "ds", F.col("yhat").alias("cells"))
    rows = ahead.join(raw, [*UF, "ds"]).join(every, [*UF, "ds"]).withColumn("dow", labels.dow(F.col("ds"))).join(floor, [*UF, "dow"], "left")
    means = rows.groupBy(*UF).agg(micro_mean(F.col("cells")).alias("mean"))
    ratio = F.least(F.greatest(F.try_divide(F.col("per_day"), F.col("mean")), F.lit(0.1)), F.lit(20.0))
    scale = F.when((F.col("mean") > 0) & (F.abs(ratio - 1) >= 0.05), ratio).otherwise(1.0)
    truth = real.select("user_id", "ds", F.col("y").alias("y_real"))
    naive = naive_dow(train, ahead.select(*UF, "ds"), tuple(UF)).withColumnRenamed("yhat", "naive_dow")
    return (
        rows.join(means, UF).withColumn("scale", rnd(scale, 6)).join(naive, [*UF, "ds"]).join(truth, ["user_id", "ds"], "left")
        .select(
            *UF, "cutoff", "ds", F.datediff("ds", "cutoff").cast("int").alias("horizon_day"), "raw",
            rnd(F.greatest("raw", F.coalesce("p25", F.lit(0.0))), 4).alias("floored"), "cells",
            rnd(F.col("cells") * F.col("scale"), 6).alias("service"), "scale", "naive_dow", "naive_mean",
            F.coalesce("y_real", F.lit(0)).alias("y"), F.col("y_real").isNull().alias("is_imputed_day"),
        )
    )


def first_seen(rows: DataFrame, plan: list[tuple[str, str, int]]) -> DataFrame:
    """History by product as each fold knew it: a row a product, its quantity and
    that of each slot and period up to every cutoff. Made in one exchange of the
    lines, like ``forecast.cells``; store it."""
    first = F.lit(len(plan))
    for i, (_, cutoff, _) in reversed(list(enumerate(plan))):
        first = F.when(F.col("order_date") <= F.lit(cutoff).cast("date"), i).otherwise(first)
    known = dealt(rows.withColumn("first", first).filter(F.col("first") < len(plan)), F.col("first").cast("tinyint").alias("first"))
    until = lambda i: F.col("first") <= i
    fields = [(f"{q}_{i}", in_period(p, also=until(i))) for i in range(len(plan)) for p, q in enumerate(QTY)]
    totals = [(f"qty_{i}", F.sum(F.when(until(i), F.col("quantity")))) for i in range(len(plan))]
    slots = known.groupBy("user_id", "product", "slot").agg(*[e.alias(n) for n, e in [*fields, *totals]])
    return slots.groupBy("user_id", "product").agg(*[F.sum(n).alias(n) for n, _ in totals], F.collect_list(F.struct("slot", *[n for n, _ in fields])).alias("cells"))


def fold_cells(known: DataFrame, plan: list[tuple[str, str, int]], more: tuple[str, ...] = ()) -> DataFrame:
    """The cells of every fold, read off the stored rows of ``first_seen``: they
    grow by the folds without being stored, sorted or exchanged. ``more`` columns
    of the rows are kept."""
    at = lambda i: lambda c: F.struct(c["slot"].alias("slot"), *[c[f"{q}_{i}"].alias(q) for q in QTY])
    folds = F.array(*[F.struct(F.lit(name).alias("fold"), F.col(f"qty_{i}").alias("product_qty"), F.transform("cells", at(i)).alias("cells")) for i, (name, _, _) in enumerate(plan)])
    return known.select("user_id", "product", *more, F.inline(folds)).filter(F.col("product_qty").isNotNull())


def horizon_bucket(day: Column) -> Column:
    return F.when(day <= 7, "1-7d").when(day <= 14, "8-14d").when(day <= 21, "15-21d").when(day <= 31, "22-31d")


def real_days(scored: DataFrame) -> DataFrame:
    """Real days with sales only, with the columns to slice by."""
    rows = scored.filter(~F.col("is_imputed_day") & (F.col("y") > 0)).withColumn("yhat", F.col(HEADLINE))
    return calendar.with_calendar(rows, ["occasion"]).withColumns({
        "occ_family": labels.occasion_family(F.col("occasion")),
        "month": F.date_format("ds", "yyyy-MM"),
        "day_name": labels.day_name(F.col("ds")),
        "horizon_bucket": horizon_bucket(F.col("horizon_day")),
    })


def metrics(rows: DataFrame, keys: list[str], yhat: str = "yhat", y: str = "y") -> DataFrame:
    """n, MAE, RMSE, WAPE, MAPE (y > 0), bias and means."""
    e, a = F.col(yhat) - F.col(y), F.col(y)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), rnd(micro_mean(F.abs(e))).alias("mae"), rnd(F.sqrt(F.avg(e * e))).alias("rmse"),
        rnd(F.try_divide(micro_sum(F.abs(e)), micro_sum(F.abs(a))) * 100.0, 1).alias("wape"),
        rnd(F.avg(F.when(a > 0, F.abs(e) / a)) * 100.0, 1).alias("mape"),
        rnd(micro_mean(e)).alias("mbe"), rnd(micro_mean(a), 1).alias("y_mean"), rnd(micro_mean(F.col(yhat)), 1).alias("yhat_mean"),
    )


def period_rows(scored: DataFrame, cells: DataFrame, real: DataFrame) -> DataFrame:
    """Forecast and actual units of every real day and period: the headline
    forecast split by the shares its fold knew."""
    days = scored.select(*UF, "ds", "yhat")
    split = factored.by_day(days, cells, {"yhat": F.lit(1.0)}, ["time_period"], by=UF)
    truth = real.groupBy("user_id", F.col("order_date").alias("ds"), labels.time_period(F.col("hour")).alias("time_period")).agg(F.sum("quantity").alias("y"))
    return split.join(truth, ["user_id", "ds", "time_period"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def test_units(scored: DataFrame, real: DataFrame) -> DataFrame:
    """Real units of every fold's scored days by product and period."""
    rows = real.withColumn("ds", F.col("order_date")).withColumn("time_period", labels.time_period(F.col("hour")))
    return rows.join(scored.select(*UF, "ds"), ["user_id", "ds"]).groupBy(*UF, "ds", "product", "time_period").agg(F.sum("quantity").alias("y"))


def top_product_rows(scored: DataFrame, cells: DataFrame, real: DataFrame, n: int = 15) -> DataFrame:
    """Forecast and actual units per scored day of the products sold most in the folds' test days."""
    sold = through_table(test_units(scored, real).groupBy(*UF, "ds", "product").agg(F.sum("y").alias("y")), "sold")
    volume = sold.groupBy("user_id", "product").agg(F.sum("y").alias("volume"))
    top = through_table(top_k(volume, ["user_id"], [F.desc("volume"), F.col("product")], n).select("user_id", "product"), "most-sold")
    split = factored.product_days(scored.select(*UF, "ds", "yhat"), cells, UF, top)
    return split.join(sold, [*UF, "ds", "product"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def sold_cells(scored: DataFrame, known: DataFrame, real: DataFrame) -> DataFrame:
    """The stored rows of ``first_seen`` with ``sold``: the real units of the scored
    days on which the product was sold (ds, y)."""
    days = scored.select("user_id", "ds").distinct()
    units = real.select("user_id", F.col("order_date").alias("ds"), "product", "quantity").join(days, ["user_id", "ds"], "left_semi").groupBy(
        "user_id", "product", "ds").agg(F.sum("quantity").alias("y"))
    sold = units.groupBy("user_id", "product").agg(F.collect_list(F.struct("ds", "y")).alias("sold"))
    return known.join(sold.hint("shuffle_hash"), ["user_id", "product"], "left")


def product_metrics(scored: DataFrame, cells: DataFrame, sold: DataFrame) -> DataFrame:
    """The metrics of every product that a fold knew over all its scored days, from
    the sums of its rows; ``sold`` are the ``cells`` of every fold with ``sold``."""
    sums = grid.product_errors(scored.select(*UF, "ds", "yhat"), cells, sold, UF)
    s = sums.groupBy("product").agg(*[F.sum(c).alias(c) for c in sums.columns if c != "product"])
    mean = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n").cast("double"))
    ratio = F.try_divide(F.col("abs_e") / float(MICRO), F.col("abs_y") / float(MICRO))
    return s.select(
        F.lit("product").alias("dimension"), F.col("product").alias("value"), "n", rnd(mean("abs_e") / float(MICRO)).alias("mae"), rnd(F.sqrt(mean("square"))).alias("rmse"),
        rnd(ratio * 100.0, 1).alias("wape"), rnd(F.try_divide(F.col("ape"), F.col("n_ape").cast("double")) * 100.0, 1).alias("mape"),
        rnd(mean("e") / float(MICRO)).alias("mbe"), rnd(mean("y") / float(MICRO), 1).alias("y_mean"), rnd(mean("yhat") / float(MICRO), 1).alias("yhat_mean"))


def sliced(rows: DataFrame, periods: DataFrame, products: DataFrame) -> DataFrame:
    """The metrics by each slicing column, in one aggregation; by period from the
    split forecast. ``products`` are the metrics of every product."""
    dims = ("fold", "day_name", "occ_family", "horizon_bucket", "month")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    one = lambda df, name: df.select("yhat", F.col("y").cast("bigint").alias("y"), F.lit(name).alias("dimension"), F.col(name).alias("value"))
    every = rows.select("yhat", "y", F.inline(pairs)).unionByName(one(periods, "time_period"))
    return metrics(every, ["dimension", "value"]).unionByName(products)


def model_compare(rows: DataFrame) -> DataFrame:
    """All variants of the model and the naive baselines, side by side."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in MODELS])
    return metrics(rows.select("user_id", "y", F.inline(pairs)), ["user_id", "model"], "pred")


def inflation(rows: DataFrame, slot_total: DataFrame) -> DataFrame:
    """Ratio of the cell sum before normalising to the headline, by fold."""
    keyed = factored.with_slot(rows).join(slot_total, [*UF, "season", "dow"], "left")
    ratio = keyed.withColumn("ratio", rnd(F.try_divide(F.col("cells") * F.coalesce("slot_sum", F.lit(1.0)), F.col("yhat")), 6))
    return ratio.groupBy("fold").agg(
        rnd(micro_mean(F.col("ratio")), 3).alias("mean"), rnd(F.median("ratio"), 3).alias("median"),
        rnd(F.min("ratio"), 3).alias("min"), rnd(F.max("ratio"), 3).alias("max"),
    )


def worst_days(rows: DataFrame, n: int = 10) -> DataFrame:
    e = rows.withColumn("err", rnd(F.col("yhat") - F.col("y"), 4))
    cols = ["user_id", "fold", "ds", "y", "yhat", "err", "place"]
    over = top_k(e, ["user_id"], [F.desc("err"), F.col("ds"), F.col("fold")], n).select(F.lit("over").alias("side"), *cols)
    under = top_k(e, ["user_id"], [F.col("err"), F.col("ds"), F.col("fold")], n).select(F.lit("under").alias("side"), *cols)
    return over.unionByName(under)


def histogram(rows: DataFrame, value: Column, bins: int, keys: list[str]) -> DataFrame:
    """Counts in equal bins between the minimum and maximum of each group; the
    maximum belongs to the last bin."""
    v = rows.withColumn("v", value)
    bounds = v.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), rnd(micro_mean(F.col("v")), 4).alias("mean"))
    width = F.try_divide(F.col("hi") - F.col("lo"), F.lit(float(bins)))
    bucket = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return v.join(bounds, keys).groupBy(*keys, bucket.alias("bin"), "mean").agg(F.count("*").alias("n"))


def renormalised(cells: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Cells scaled so that each date adds up to the given daily total."""
    sums = cells.groupBy("user_id", "ds").agg(micro_sum(F.col("yhat")).alias("cell_sum"))
    scale = F.when(F.col("cell_sum") > 0, F.col("yhat") / F.col("cell_sum") * F.col("daily")).otherwise(0.0)
    return cells.join(sums, ["user_id", "ds"]).join(totals.select("user_id", "ds", F.col("units").alias("daily")), ["user_id", "ds"]).select(
        *keys, rnd(scale, 4).alias("yhat")
    )


def cell_totals(scored: DataFrame, cells: DataFrame, real: DataFrame) -> DataFrame:
    """Forecast and actual of the scored days per period and per product."""
    split = factored.wide_totals(scored.select(*UF, "ds", "yhat"), cells, UF)
    y = [F.sum(F.when(F.col("time_period") == p, F.col("y"))).alias(f"y_{p}") for p in labels.PERIODS]
    truth = test_units(scored, real).groupBy(*UF, "product").agg(*y)
    # the few test days are looked up by hash, so the products are not sorted
    rows = split.join(truth.hint("shuffle_hash"), [*UF, "product"], "left")
    units = {p: F.rint(F.col(p) * float(MICRO)).cast("bigint") for p in labels.PERIODS}
    added = lambda columns: reduce(lambda a, b: a + b, columns)
    both = lambda d, name, total, real: F.struct(F.lit(d).alias("dimension"), name.alias("name"), total.alias("total"), real.alias("y"))
    pairs = [both("time_period", F.lit(p), units[p], F.col(f"y_{p}")) for p in labels.PERIODS]
    pairs.append(both("product", F.col("product"), added(units.values()), added([F.coalesce(f"y_{p}", F.lit(0)) for p in labels.PERIODS])))
    return rows.select("user_id", F.inline(F.array(*pairs))).groupBy("user_id", "dimension", "name").agg(
        rnd(F.sum("total") / float(MICRO), 3).alias("yhat"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")
    )


# -- pattern measures ----------------------------------------------------------


def safe_corr(a: Column, b: Column, least: int = 3) -> Column:
    """Correlation over complete pairs: NULL under ``least`` pairs, 0 when a
    side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    dx, dy = F.stddev_pop(x), F.stddev_pop(y)
    # not corr(): under ANSI it raises on a constant side before any guard
    return F.when(F.count_if(both) < least, None).when((dx < TINY) | (dy < TINY), 0.0).otherwise(F.try_divide(F.covar_pop(x, y), dx * dy))


def with_lag(rows: DataFrame, keys: list[str], value: str, lags: tuple[int, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ds")
    return rows.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in lags})


def autocorr(rows: DataFrame, keys: list[str], value: str, lag: int) -> DataFrame:
    """Lag correlation by position; NULL under lag + 3 points."""
    col = f"{value}_lag{lag}"
    c = safe_corr(F.col(value), F.col(col), 3)
    return with_lag(rows, keys, value, (lag,)).groupBy(*keys).agg(rnd(F.when(F.count(value) >= lag + 3, c), 4).alias(f"lag{lag}"))


def weekday_strength(rows: DataFrame, keys: list[str], value: str, name: str = "strength") -> DataFrame:
    """Range of weekday means over the sample deviation."""
    by_dow = rows.groupBy(*keys, labels.dow(F.col("ds")).alias("dow")).agg(F.avg(value).alias("m"))
    rng = by_dow.groupBy(*keys).agg((F.max("m") - F.min("m")).alias("rng"))
    dev = rows.groupBy(*keys).agg(F.stddev_samp(value).alias("dev"))
    return rng.join(dev, keys).select(*keys, rnd(F.col("rng") / F.when(F.col("dev") > 0, F.col("dev")).otherwise(TINY), 4).alias(name))


def fft7(rows: DataFrame, keys: list[str], value: str, name: str = "fft7") -> DataFrame:
    """Amplitude of the frequency bin nearest to one week, over n times the
    mean; NULL under 14 points. One bin needs two sums, not a transform."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    base = rows.withColumns({"j": F.row_number().over(w.orderBy("ds")) - 1, "n": n, "mean": F.avg(value).over(w)})
    k = F.floor(F.col("n") / 7.0) + F.when(F.col("n") / 7.0 - F.floor(F.col("n") / 7.0) > 0.5, 1).otherwise(0)
    angle = k * F.col("j") / F.col("n") * (2 * math.pi)
    dev = F.col(value) - F.col("mean")
    sums = base.groupBy(*keys).agg(F.sum(dev * F.cos(angle)).alias("re"), F.sum(dev * F.sin(angle)).alias("im"), F.max("n").alias("n"), F.max("mean").alias("mean"))
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("n") * F.when(F.col("mean") == 0, TINY).otherwise(F.col("mean")))
    return sums.select(*keys, rnd(F.when(F.col("n") >= 14, amp), 5).alias(name))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties at their average, over groups as small as a week."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0


def spearman(rows: DataFrame, keys: list[str], a: str, b: str, name: str = "spearman", digits: int = 4) -> DataFrame:
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = both.withColumns({"ra": average_rank(a, keys), "rb": average_rank(b, keys)})
    return r.groupBy(*keys).agg(rnd(safe_corr(F.col("ra"), F.col("rb")), digits).alias(name))


def weekday_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, labels.dow(F.col("ds")).alias("dow")).agg(
        rnd(F.avg("yhat"), 6).alias("fc_mean"), rnd(F.avg("y"), 6).alias("ac_mean")
    )


def naive28(train: DataFrame, days: DataFrame, keys: tuple[str, ...] = ("user_id",), lookback: int = 28) -> DataFrame:
    """Weekday mean of the last 28 training days of each series."""
    ends = train.groupBy(*keys).agg(F.max("ds").alias("end"))
    recent = train.join(ends, list(keys)).filter(F.col("ds") >= F.date_sub("end", lookback - 1)).drop("end")
    return naive_dow(recent, days, keys)


def mapd(a: str, b: str) -> Column:
    base = F.col(b) > TINY
    return F.avg(F.when(base, F.abs(F.col(a) - F.col(b)) / F.col(b))) * 100.0


def pattern(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All pattern measures of a series. ``rows``: ds, yhat, y (NULL unless a
    real day) and the 28-day baseline ``naive``."""
    real = rows.filter(F.col("y").isNotNull())
    e = F.abs(F.col("yhat") - F.col("y"))
    base = real.groupBy(*keys).agg(
        F.count("*").alias("real_days"), rnd(micro_mean(F.col("y")), 1).alias("mean_actual"), rnd(micro_mean(F.col("yhat")), 1).alias("mean_forecast"),
        rnd(micro_mean(e), 1).alias("mae"), F.stddev_samp("yhat").alias("sf"), F.stddev_samp("y").alias("sa"),
    )
    whole_window = rows.groupBy(*keys).agg(
        rnd(mapd("yhat", "naive"), 1).alias("mapd_naive"), F.stddev_samp("yhat").alias("wf"), F.stddev_samp("naive").alias("wn")
    )
    ratio = lambda a, b: rnd(F.when(F.col(b) > TINY, F.col(a) / F.col(b)), 5)
    out = base.join(whole_window, keys)
    parts = [
        autocorr(real, keys, "yhat", 7).withColumnRenamed("lag7", "lag7_fc"), autocorr(real, keys, "y", 7).withColumnRenamed("lag7", "lag7_ac"),
        weekday_strength(real, keys, "yhat", "ws_fc"), weekday_strength(real, keys, "y", "ws_ac"),
        fft7(real, keys, "yhat", "fft_fc"), fft7(real, keys, "y", "fft_ac"),
        spearman(weekday_means(real, keys), keys, "fc_mean", "ac_mean"),
    ]
    for part in parts:
        out = out.join(part, keys, "left")
    return out.withColumns({
        "var_ratio": ratio("sf", "sa"), "var_over_naive": ratio("wf", "wn"), "fft_ratio": rnd(F.when(F.col("fft_ac") > 0, F.col("fft_fc") / F.col("fft_ac")), 5),
    }).drop("sf", "sa", "wf", "wn")


def graded(p: DataFrame) -> DataFrame:
    """Pattern score, anti-replication score and the 1 to 5 grade."""
    within = lambda c: F.coalesce(c.between(0.5, 1.5), F.lit(False)).cast("int")
    lag = (F.col("lag7_fc") * F.col("lag7_ac") >= 0) & (F.abs(F.col("lag7_fc") - F.col("lag7_ac")) <= 0.25)
    a = (
        F.coalesce(F.col("spearman") >= 0.6, F.lit(False)).cast("int") + within(F.col("var_ratio")) + F.coalesce(lag, F.lit(False)).cast("int")
        + within(F.when(F.col("ws_ac") > 1e-6, F.col("ws_fc") / F.col("ws_ac"))) + within(F.col("fft_ratio"))
    )
    m = F.col("mapd_naive")
    b = F.when(m >= 30, 5).when(m >= 20, 4).when(m >= 12, 3).when(m >= 6, 2).otherwise(1)
    flat = F.coalesce(F.col("var_over_naive") < 1.05, F.lit(False)) & (F.col("b0") > 2)
    scored = p.withColumns({"pattern_score": a, "b0": b}).withColumn("replication_score", F.when(flat, 2).otherwise(F.col("b0")))
    grade = F.least(F.greatest(whole((F.col("pattern_score") + F.col("replication_score")) / 2.0), F.lit(1)), F.lit(5)).cast("int")
    return scored.withColumn("grade", grade).drop("b0")


# -- validation surfaces ---------------------------------------------------------


def real_heatmap(real: DataFrame) -> DataFrame:
    """Units per weekday and hour and occurrence of the weekday, all 168 cells."""
    spark = real.sparkSession
    grid = values(spark, [(d, h) for d in range(7) for h in range(24)], "dow int, hour int")
    dow = labels.dow(F.col("order_date"))
    by_day = real.groupBy("user_id", "order_date", "hour").agg(F.sum("quantity").alias("q"))
    cells = by_day.groupBy("user_id", dow.alias("dow"), "hour").agg(F.sum("q").alias("units"))
    occur = by_day.select("user_id", "order_date").distinct().groupBy("user_id", dow.alias("dow")).agg(F.count("*").alias("n"))
    users = occur.select("user_id").distinct()
    return users.crossJoin(F.broadcast(grid)).join(cells, ["user_id", "dow", "hour"], "left").join(occur, ["user_id", "dow"], "left").select(
        "user_id", "dow", "hour", rnd(F.coalesce(share(F.col("units"), F.col("n")), F.lit(0.0)), 4).alias("units_per_day")
    )


def cell_agreement(cells: DataFrame, n: int = 5) -> DataFrame:
    """Peak cell match, Jaccard of the top cells and correlation of two grids
    (``pred``, ``real``) of at most 168 cells per workspace."""
    w = Window.partitionBy("user_id")
    at = lambda c: F.row_number().over(w.orderBy(F.desc(c), "dow", "hour"))
    r = cells.withColumns({"pa": at("pred"), "ra": at("real")})
    both, either = F.count_if((F.col("pa") <= n) & (F.col("ra") <= n)), F.count_if((F.col("pa") <= n) | (F.col("ra") <= n))
    return r.groupBy("user_id").agg(
        rnd(safe_corr(F.col("pred"), F.col("real")), 4).alias("pearson"), rnd(both / either, 4).alias("top5_jaccard"),
        F.bool_or((F.col("pa") == 1) & (F.col("ra") == 1)).alias("peak_match"),
    )


def level(daily_forecast: DataFrame, real_daily: DataFrame, horizon: int = 30, limit: float = 20.0) -> DataFrame:
    """Mean of the next days against the trailing eight weeks of real days."""
    ends = real_daily.groupBy("user_id").agg(F.max("ds").alias("end"))
    recent = real_daily.join(ends, "user_id").filter(F.col("ds") >= F.date_sub("end", 55)).groupBy("user_id").agg(micro_mean(F.col("y")).alias("real_mean"))
    ahead = daily_forecast.join(ends, "user_id").filter(F.col("ds") > F.col("end"))
    first = top_k(ahead, ["user_id"], [F.col("ds")], horizon).groupBy("user_id").agg(micro_mean(F.col("yhat")).alias("forecast_mean"))
    dev = rnd(F.abs(F.col("forecast_mean") - F.col("real_mean")) / F.col("real_mean") * 100.0, 3)
    return recent.join(first, "user_id").select(
        "user_id", rnd(F.col("real_mean"), 3).alias("real_mean"), rnd(F.col("forecast_mean"), 3).alias("forecast_mean"), dev.alias("deviation_pct"), (dev <= limit).alias("passed")
    )


def ranked_pairs(pairs: DataFrame, name: str) -> DataFrame:
    """Minimum ranks of predicted and real values per workspace (few rows)."""
    w = Window.partitionBy("user_id")
    return pairs.select("user_id", name, rnd(F.col("pred")).alias("pred"), rnd(F.col("real")).alias("real")).withColumns({
        "pred_rank": F.rank().over(w.orderBy(F.desc("pred"))), "real_rank": F.rank().over(w.orderBy(F.desc("real"))),
    })


def rank_agreement(ranked: DataFrame, name: str, n: int) -> DataFrame:
    """Spearman and Jaccard of the first ``n`` names."""
    rho = spearman(ranked, ["user_id"], "pred", "real")
    w = Window.partitionBy("user_id")
    at = lambda c: F.row_number().over(w.orderBy(F.desc(c), name))
    top = ranked.withColumns({"pa": at("pred"), "ra": at("real")}).groupBy("user_id").agg(
        rnd(F.count_if((F.col("pa") <= n) & (F.col("ra") <= n)) / F.count_if((F.col("pa") <= n) | (F.col("ra") <= n)), 4).alias("jaccard")
    )
    return rho.join(top, "user_id")


PARTS = ("level", "weekly", "holidays", "seasons", "weather")


def components(fitted: DataFrame) -> DataFrame:
    """Which parts of the model are active, the mean effect of each weekday and
    the strongest one, and what the holidays do on first Eid days and paydays."""
    dow = labels.dow(F.col("ds"))
    hijri = calendar.with_calendar(fitted, ["occasion"]).withColumn("dow", dow)
    eid = F.col("occasion").startswith("Eid")
    pay = F.col("occasion") == "Payday"
    means = [rnd(F.avg(F.when(F.col("dow") == i, F.col("weekly"))), 3).alias(f"weekly_{n.lower()}") for i, n in enumerate(labels.WEEKDAYS)]
    agg = hijri.groupBy("user_id").agg(
        *[(F.sum(F.abs(c)) > TINY).alias(f"{c}_active") for c in PARTS], rnd(F.stddev_samp("weather"), 3).alias("weather_std"), *means,
        rnd(F.avg(F.when(eid, F.col("holidays"))), 3).alias("eid_effect"), rnd(F.avg(F.when(pay, F.col("holidays"))), 3).alias("payday_effect"),
    )
    # the first of equal effects in the order of the week
    pairs = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"weekly_{n.lower()}").isNotNull(), F.struct((-F.col(f"weekly_{n.lower()}")).alias("e"), F.lit(i).alias("i"), F.lit(n).alias("day")))
        for i, n in enumerate(labels.WEEKDAYS)])))
    return agg.withColumn("weekly_peak", F.get(pairs, F.lit(0))["day"])


def component_sample(fitted: DataFrame, dates: list[str]) -> DataFrame:
    """The parts of the model on given dates, where the model covers them."""
    return fitted.filter(F.col("ds").isin(*[F.lit(d).cast("date") for d in dates])).select(
        "user_id", "ds", *[rnd(F.col(c), 3).alias(c) for c in PARTS])


def spot_checks(spark, cases: list[tuple[str, str, bool]]) -> DataFrame:
    """Labels of given dates next to the ones they must have."""
    days = values(spark, cases, "ds string, expected string, expected_payday boolean").withColumn("ds", F.col("ds").cast("date"))
    found = calendar.with_calendar(days, ["occasion", "is_payday"])
    ok = F.contains(F.lower("occasion"), F.lower("expected")) & (F.col("is_payday") == F.col("expected_payday"))
    return found.withColumn("passed", F.coalesce(ok, F.lit(False)))


def gates(parts: dict[str, DataFrame]) -> DataFrame:
    """Pass or fail of each check per workspace, with the number passed.
    ``parts`` maps a gate to a frame (user_id, passed)."""
    out = None
    for name, df in parts.items():
        row = df.select("user_id", F.lit(name).alias("gate"), F.coalesce("passed", F.lit(False)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("n_passed", F.count_if("passed").over(Window.partitionBy("user_id")))
