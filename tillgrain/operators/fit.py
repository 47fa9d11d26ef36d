"""Additive regression of many daily series in one pass.

The design of a date (level, weekly waves, holiday indicators, season flags,
temperature) is the same for every series, so it is one matrix over the
calendar. A task streams its series; each is bounded by the calendar. The
weighted sums of a series are built once, segment by segment between the cutoffs
of all its models, and added up: a rolling origin costs one solve, not one pass.
The systems of many series are solved as one stack. The prior of each block of
coefficients becomes a ridge penalty.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillgrain.functions import labels
from tillgrain.functions.numeric import micro_mean, rnd, share
from tillgrain.operators import calendar
from tillgrain.operators.forecast import FEATURES, SEASON_FLAGS, WEEKLY, weighted

# Prior scale of the level; all other priors are wide, so that the
# smallest penalty, which keeps rarely seen indicators near zero, decides.
PRIOR_LEVEL, MIN_PENALTY = 5.0, 1.0
BLOCKS = {"weekly": WEEKLY, "holidays": calendar.HOLIDAY_KEYS, "seasons": SEASON_FLAGS, "weather": ["temp_max"]}
PARTIAL = 0.30
#: prior scale and smallest penalty of the earlier script
LEGACY_PRIOR, LEGACY_PENALTY = 10.0, 1e-6
#: places of fitted values: sums of a series agree to far more whatever the order
DIGITS = 3
#: systems solved at a time, and rows of a result batch
STACK, OUT_ROWS = 256, 50_000
#: the design is sent to every task, so the calendar it covers is bounded
MOST_DAYS = 100_000
EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Model:
    """One fit of every series: the days it learns from and those it predicts.

    It learns from the days up to ``cutoff``, from the first ``part`` of the
    days, or from all; ``robust`` leaves out days under 30 % of the median of
    their weekday; ``drop`` names a block of features to leave out. ``days`` is
    ``own`` (the days of the series), ``span`` (every day from its first to
    ``until``) or ``after`` (``horizon`` days past the cutoff).
    """

    name: str
    cutoff: str | None = None
    part: float | None = None
    robust: bool = False
    drop: str | None = None
    days: str = "own"
    horizon: int = 0


class Design:
    """Rows of the feature matrix by day; column 0 is the level."""

    def __init__(self, first: int, matrix: np.ndarray) -> None:
        self.first, self.x = first, np.column_stack([np.ones(len(matrix)), matrix])
        self.temp = 1 + FEATURES.index("temp_max")
        self.x[:, self.temp] = (self.x[:, self.temp] - calendar.DEFAULT_TEMP) / 10.0
        self.blocks = {b: np.array([1 + FEATURES.index(f) for f in names]) for b, names in BLOCKS.items()}

    def rows(self, days: np.ndarray) -> np.ndarray:
        return self.x[days - self.first]


def design_of(features: DataFrame) -> Design:
    """The feature table (one row per date) as a matrix without gaps."""
    table = features.select("ds", *FEATURES).orderBy("ds").limit(MOST_DAYS + 1).toArrow()
    days = table.column("ds").cast(pa.int32()).to_numpy()
    if len(days) > MOST_DAYS or (len(days) and days[-1] - days[0] + 1 != len(days)):
        raise ValueError(f"the design needs at most {MOST_DAYS} days without a gap")
    matrix = np.column_stack([table.column(f).cast(pa.float64()).to_numpy() for f in FEATURES])
    return Design(int(days[0]) if len(days) else 0, matrix)


def _day(text: str) -> int:
    return (dt.date.fromisoformat(text) - EPOCH).days


def learned(model: Model, days: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray]:
    """How many of the first days a model learns from, and which of them it leaves out."""
    n = len(days)
    if model.cutoff is not None:
        n = int(np.searchsorted(days, _day(model.cutoff), side="right"))
    elif model.part is not None:
        n = int(n * model.part)
    out = np.zeros(n, bool)
    if model.robust:
        weekday = (days[:n] + 3) % 7
        for d in range(7):
            at = weekday == d
            if at.any():
                out[at] = y[:n][at] < np.median(y[:n][at]) * PARTIAL
    return n, np.flatnonzero(out)


def gram(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted sums of products of the columns and, last, with ``y``."""
    return (x * weight[:, None]).T @ np.column_stack([x, y])


def system(design: Design, sums: np.ndarray, weight: np.ndarray, y: np.ndarray, temps: np.ndarray, drop: str | None) -> tuple[np.ndarray, float, float]:
    """Sums with the penalty added and temperature standardised by the learned
    days; also its centre and spread."""
    t, s = design.temp, sums.copy()
    center, spread = float(temps.mean()), float(temps.std())
    spread = spread if spread > 1e-9 else 1.0
    s[t] = (s[t] - center * s[0]) / spread
    s[:, t] = (s[:, t] - center * s[:, 0]) / spread
    total = weight.sum()
    mean = (weight * y).sum() / total
    noise = max(float((weight * (y - mean) ** 2).sum() / total) / max(float(np.abs(y).max()), 1e-9) ** 2, 1e-9)
    p = len(s)
    s[np.arange(p), np.arange(p)] += np.concatenate([[noise / PRIOR_LEVEL**2], np.full(p - 1, MIN_PENALTY)])
    if drop is not None:
        gone = design.blocks[drop]
        s[gone], s[:, gone] = 0.0, 0.0
        s[gone, gone] = 1.0
    return s, center, spread


class Solver:
    """Collects the systems of many series, solves them as a stack and hands out result batches."""

    def __init__(self, design: Design, models: list[Model], keys: list[str], schema: pa.Schema) -> None:
        self.design, self.models, self.keys, self.schema = design, models, keys, schema
        self.waiting: list[tuple] = []
        self.done: list[list[pa.Array]] = []
        self.size = 0

    def add(self, key: tuple, days: np.ndarray, y: np.ndarray, weight: np.ndarray, imputed: np.ndarray, until: int) -> None:
        x = self.design.rows(days)
        plans = [(m, *learned(m, days, y)) for m in self.models]
        cuts = sorted({n for _, n, _ in plans if n})
        sums, total, a = {}, 0.0, 0
        for b in cuts:
            total = total + gram(x[a:b], weight[a:b], y[a:b])
            sums[b], a = total, b
        for m, n, out in plans:
            span = {"own": lambda: days, "span": lambda: np.arange(days[0], until + 1, dtype=days.dtype),
                    "after": lambda: _day(m.cutoff) + 1 + np.arange(m.horizon, dtype=days.dtype)}[m.days]()
            keep = np.delete(np.arange(n), out)
            solved = None
            if len(keep):
                s = sums[n] - gram(x[out], weight[out], y[out]) if len(out) else sums[n]
                solved = system(self.design, s, weight[keep], y[keep], x[keep, self.design.temp], m.drop)
            self.waiting.append((key, m, span, solved, days, y, imputed, n, out))

    def solve(self) -> None:
        live = [w for w in self.waiting if w[3] is not None]
        if live:
            stack = np.stack([w[3][0] for w in live])
            betas = iter(np.linalg.solve(stack[:, :, :-1], stack[:, :, -1:])[:, :, 0])
        for key, m, span, solved, days, y, imputed, n, out in self.waiting:
            beta, center, spread = (next(betas), *solved[1:]) if solved is not None else (np.zeros(self.design.x.shape[1]), 0.0, 1.0)
            z = self.design.rows(span).copy()
            z[:, self.design.temp] = (z[:, self.design.temp] - center) / spread
            parts = {b: z[:, at] @ beta[at] for b, at in self.design.blocks.items()}
            at = np.minimum(np.searchsorted(days, span), len(days) - 1)
            hit = days[at] == span
            learns = hit & (at < n) & ~np.isin(at, out)
            rows = len(span)
            self.done.append([
                *[pa.array([k] * rows, f.type) for k, f in zip(key, self.schema)], pa.array([m.name] * rows, pa.string()),
                pa.array(span.astype(np.int32)).cast(pa.date32()), pa.array(np.where(hit, y[at], 0.0), mask=~hit), pa.array(imputed[at] & hit),
                pa.array(learns), pa.array(beta[0] + sum(parts.values())), pa.array(np.full(rows, beta[0])), *(pa.array(parts[b]) for b in BLOCKS)])
            self.size += rows
        self.waiting = []

    def batches(self, last: bool) -> Iterator[pa.RecordBatch]:
        if last or len(self.waiting) >= STACK:
            self.solve()
        if self.done and (last or self.size >= OUT_ROWS):
            cols = [pa.concat_arrays(c) for c in zip(*self.done)]
            self.done, self.size = [], 0
            yield pa.record_batch(cols, schema=self.schema)


OUT = ("model string, ds date, y double, is_imputed boolean, train boolean, raw double, level double, "
       "weekly double, holidays double, seasons double, weather double")


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fits cost CPU, not bytes: a fixed partition count keeps the runtime from
    merging small partitions into one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys)


def fit(history: DataFrame, keys: list[str], features: DataFrame, models: list[Model]) -> DataFrame:
    """Every model of every series: keys, model, ds, y (NULL where the series has
    no such day), is_imputed, train, raw and its components, and ``yhat``, which is
    ``raw`` rounded and not below 0.

    ``history`` holds the keys, ds (at most once per series), y, is_imputed and,
    for models that predict a span, ``until``. A series that gives a model nothing
    to learn from is predicted as 0.
    """
    design = design_of(features)
    rows = weighted(history)
    if "until" not in rows.columns:
        rows = rows.withColumn("until", F.col("ds"))
    rows = rows.select(*keys, "ds", F.col("y").cast("double").alias("y"), "weight", "is_imputed", "until")
    kinds = [(k, rows.schema[k].dataType) for k in keys]
    ddl = ", ".join(f"{k} {t.simpleString()}" for k, t in kinds) + ", " + OUT
    arrow = pa.schema([(k, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[t.simpleString()]) for k, t in kinds] + [
        ("model", pa.string()), ("ds", pa.date32()), ("y", pa.float64()), ("is_imputed", pa.bool_()), ("train", pa.bool_()), ("raw", pa.float64()),
        ("level", pa.float64()), *((b, pa.float64()) for b in BLOCKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, held = Solver(design, models, keys, arrow), None

        def series(table: pa.Table) -> tuple:
            number = lambda c: table.column(c).cast(pa.int32()).to_numpy().astype(np.int64)
            value = lambda c: table.column(c).to_numpy()
            return (tuple(table.column(k)[0].as_py() for k in keys), number("ds"), value("y"), value("weight"),
                    np.asarray(value("is_imputed"), bool), int(number("until")[-1]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            codes = [table.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
            starts = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
            bounds = [0, *starts.tolist()]
            for a, b in zip(bounds[:-1], bounds[1:]):
                solver.add(*series(table.slice(a, b - a)))
                yield from solver.batches(False)
            held = table.slice(bounds[-1])
        if held is not None and held.num_rows:
            solver.add(*series(held))
        yield from solver.batches(True)

    done = spread(rows, keys).sortWithinPartitions(*keys, "ds").mapInArrow(run, ddl)
    return done.withColumn("yhat", rnd(F.greatest(F.col("raw"), F.lit(0.0)), DIGITS))


def holdout_mae(fitted: DataFrame) -> DataFrame:
    """Mean error on the days that the model of the first 80 % did not see."""
    return fitted.filter(~F.col("train")).groupBy("user_id").agg(rnd(micro_mean(F.abs(F.col("y") - F.col("yhat"))), 2).alias("mae"))


def split_by_period(forecast: DataFrame, cells: DataFrame) -> DataFrame:
    """Daily values of a product by its own period shares: a column each."""
    held = lambda i: F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c[f"q{i}"], F.lit(0).cast("bigint")))
    totals = cells.select("user_id", "product", F.col("product_qty").alias("all_qty"), *[held(i).alias(f"qty_{p}") for i, p in enumerate(labels.PERIODS)])
    ratio = lambda p: share(F.col(f"qty_{p}"), F.col("all_qty"))
    return forecast.join(totals, ["user_id", "product"]).select(
        "user_id", "ds", "product", F.col("y").cast("bigint").alias("y"), *[rnd(rnd(F.col("yhat") * ratio(p), 10), 6).alias(p) for p in labels.PERIODS]
    )


def long_periods(wide: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(p).alias("time_period"), F.col(p).alias("yhat")) for p in labels.PERIODS])
    return wide.select("user_id", "ds", "product", F.inline(pairs))


# -- earlier per-series script: period-level rows with label codes ------------


def solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, floor: float = MIN_PENALTY) -> np.ndarray:
    """Weighted ridge by the normal equations; the first column is the level."""
    scale = max(float(np.abs(y).max()), 1e-9)
    z = y / scale
    noise = max(float(np.average((z - np.average(z, weights=weight)) ** 2, weights=weight)), 1e-9)
    penalty = np.maximum(noise / prior**2, floor)
    penalty[0] = noise / PRIOR_LEVEL**2
    gram = (x * weight[:, None]).T @ x + np.diag(penalty)
    return np.linalg.solve(gram, (x * weight[:, None]).T @ z) * scale

def dense_series(sales: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Every date x period between the first and last sale of a series: missing
    quantities 0, labels carried forward then backward. Series with fewer than
    ten rows are left out. Windows are bounded by the calendar x 4."""
    from pyspark.sql import Window
    from tillgrain.functions.tables import values

    rows = calendar.with_calendar(sales.withColumn("ds", F.col("order_date")), ["occasion", "season"])
    sold = rows.groupBy(*keys, "ds", labels.time_period(F.col("hour")).alias("time_period")).agg(
        F.sum("quantity").alias("y"), F.min("season").alias("season"), F.min("occasion").alias("occasion")
    )
    bounds = sold.groupBy(*keys).agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    periods = values(sales.sparkSession, [(p, i) for i, p in enumerate(labels.PERIODS)], "time_period string, period_code int")
    dense = calendar.spine(bounds, "a", "b", keys).crossJoin(F.broadcast(periods)).join(sold, [*keys, "ds", "time_period"], "left")
    # both directions as running frames: a frame that ends in UNBOUNDED FOLLOWING
    # is evaluated anew for every row
    ahead = Window.partitionBy(*keys).orderBy("ds", "period_code").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.desc("ds"), F.desc("period_code")).rowsBetween(Window.unboundedPreceding, 0)
    fill = lambda c: F.coalesce(F.last(c, True).over(ahead), F.last(c, True).over(back))
    size = F.count("*").over(Window.partitionBy(*keys))
    return dense.withColumns({"y": F.coalesce("y", F.lit(0)), "season": fill("season"), "occasion": fill("occasion"), "_n": size}).filter(
        F.col("_n") >= least
    ).drop("_n")


def legacy_fit(dense: DataFrame, keys: list[str], horizon: int = 30) -> DataFrame:
    """Trend, weekly terms and label codes per series; rounded predictions for
    the history and 30 more days with the last labels."""
    names = ", ".join(f"{k} {dense.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ds", "period_code"]).reset_index(drop=True)
        for c in ("season", "occasion"):
            pdf[c] = pdf[c].astype("category").cat.codes
        last = pdf.iloc[-1]
        days = pd.date_range(pd.Timestamp(last["ds"]) + pd.Timedelta(days=1), periods=horizon)
        k = len(labels.PERIODS)
        ahead = pd.DataFrame({
            "ds": np.repeat(days.date, k), "time_period": list(labels.PERIODS) * horizon, "period_code": list(range(k)) * horizon,
            "y": np.nan, "season": last["season"], "occasion": last["occasion"],
        })
        full = pd.concat([pdf, ahead], ignore_index=True)
        ds = pd.to_datetime(full["ds"])
        t = (ds - ds.min()).dt.days.to_numpy(dtype=float)
        angle = 2 * np.pi * (t % 7) / 7
        waves = [f(n * angle) for n in (1, 2, 3) for f in (np.sin, np.cos)]
        x = np.column_stack([np.ones(len(t)), t / max(t.max(), 1.0), *waves, full["season"], full["occasion"], full["period_code"]])
        train = full["y"].notna().to_numpy()
        beta = solve(x[train], full.loc[train, "y"].to_numpy(dtype=float), np.ones(train.sum()), np.full(x.shape[1], LEGACY_PRIOR), LEGACY_PENALTY)
        done = pd.DataFrame({"ds": full["ds"], "time_period": full["time_period"], "y": full["y"], "yhat": np.rint(x @ beta) + 0.0,
                             "type": np.where(train, "actual", "future")})
        for i, (name, v) in enumerate(zip(keys, key)):
            done.insert(i, name, v)
        return done

    return spread(dense.withColumn("y", F.col("y").cast("double")), keys).groupBy(*keys).applyInPandas(
        run, f"{names}, ds date, time_period string, y double, yhat double, type string"
    )


def legacy_scores(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """MAE per series, and MAE and non-zero MAPE over all of them (keys NULL)."""
    actual = predictions.filter(F.col("type") == "actual")
    err = F.abs(F.col("y") - F.col("yhat"))
    ape = F.when(F.col("y") > 0, err / F.col("y") * 100.0)
    scores = [rnd(micro_mean(err), 2).alias("mae"), rnd(micro_mean(ape), 2).alias("mape")]
    every = actual.agg(*scores).select(*[F.lit(None).cast(predictions.schema[k].dataType).alias(k) for k in keys], "mae", "mape")
    return actual.groupBy(*keys).agg(*scores).unionByName(every)
