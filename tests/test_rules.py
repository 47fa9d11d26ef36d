"""Golden cases of labels, rules and formulas."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillgrain.functions import labels, rules
from tillgrain.functions.ranking import median, ranked
from tillgrain.operators import calendar, fit, forecast as fc, pricing

LABELS = [
    ("2022-07-27", "Payday", True), ("2022-05-02", "Eid al-Fitr", True), ("2022-04-15", "Ramadan", False),
    ("2022-09-23", "Saudi National Day", False), ("2022-02-22", "Saudi Founding Day", False), ("2022-08-15", "Normal Day", False),
    ("2022-07-09", "Eid al-Adha", False), ("2022-05-30", "Post-payday spending", True),
]
RAMADAN = {1415: "1995-02-01", 1422: "2001-11-16", 1443: "2022-04-02", 1447: "2026-02-18"}


def test_day_labels(spark):
    days = spark.createDataFrame([(dt.date.fromisoformat(d),) for d, _, _ in LABELS], "ds date")
    got = {str(r.ds): (r.occasion, r.is_payday) for r in calendar.with_calendar(days, ["occasion", "is_payday"]).collect()}
    assert got == {d: (o, p) for d, o, p in LABELS}


def test_hijri_anchors(spark):
    cal = calendar.calendar(spark).filter((F.col("hijri_month") == 9) & (F.col("hijri_day") == 1))
    starts = {str(r.ds) for r in cal.select("ds").collect()}
    assert set(RAMADAN.values()) <= starts


def test_calendar_has_one_row_per_day(spark):
    row = calendar.calendar(spark).agg(F.count("*").alias("n"), F.countDistinct("ds").alias("d"), (F.datediff(F.max("ds"), F.min("ds")) + 1).alias("span")).first()
    assert row.n == row.d == row.span


def test_hour_buckets(spark):
    hours = [4, 5, 11, 12, 16, 17, 21, 22]
    want = ["night", "morning", "morning", "Afternoon", "Afternoon", "Evening", "Evening", "night"]
    df = spark.createDataFrame([(h,) for h in hours], "h int").orderBy("h")
    assert [r.p for r in df.select("h", labels.time_period(F.col("h")).alias("p")).orderBy("h").collect()] == want


def test_elasticity_coverage(spark):
    want = {
        "Bakery": -1.0, "Cold Coffee Drinks": -0.8, "Cold Drinks": -1.0, "Dripp Coffee Drinks": -0.5, "Espresso Drinks": -0.5,
        "Hot Drinks": -0.7, "Hot Sweets": -1.6, "Sweets": -1.8, "Gadgets": -1.5, "": -1.5,
    }
    df = spark.createDataFrame([(c,) for c in want], "category string")
    got = {r.category: r.e for r in df.select("category", rules.elasticity(F.col("category"))["value"].alias("e")).collect()}
    assert got == want


@pytest.mark.parametrize("e, factor", [(-0.5, 1.2**-0.5), (-1.6, 1.2**-1.6)])
def test_projection(spark, e, factor):
    q = spark.range(1).select(pricing.project_qty(F.lit(100), F.lit(10.0), F.lit(12.0), F.lit(e)).alias("q")).first().q
    assert q == pytest.approx(100 * factor)


def test_round_to_total(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, d), 0.86) for d in range(1, 8)], "user_id int, ds date, yhat double")
    got = [r.units for r in fc.round_to_total(rows, ["user_id"]).orderBy("ds").collect()]
    assert got == [1, 1, 1, 1, 1, 1, 0]


def test_ranked_equals_window(spark):
    rng = np.random.default_rng(1)
    data = [(int(g), f"p{i:04d}", float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 900), rng.choice([0.0, 0.4, 3.0, 7.5, 1e6, 12.0], 900)))]
    df = spark.createDataFrame(data, "g int, p string, v double")
    got = {(r.g, r.p): r.place for r in ranked(df, ["g"], "v", "p").collect()}
    want = {}
    for g in range(3):
        for i, (_, p, _) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[2], x[1]))):
            want[g, p] = i + 1
    assert got == want


def test_median_is_exact(spark):
    rng = np.random.default_rng(2)
    data = [(int(i % 2), f"p{i}", float(v)) for i, v in enumerate(rng.normal(0, 5, 401))]
    got = {r.g: r.m for r in median(spark.createDataFrame(data, "g int, p string, v double"), ["g"], "v", "p", "m").collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.median([v for k, _, v in data if k == g]))


def plain_fit(features, days, y, w, predict, drop=()):
    """Weighted ridge of one series by the textbook, with the penalty of ``fit``."""
    x = {d: np.array([1.0, *f]) for d, f in features.items()}
    temps = np.array([x[d][-1] for d in days])
    scaled = lambda d: np.append(x[d][:-1], (x[d][-1] - temps.mean()) / (temps.std() if temps.std() > 1e-9 else 1.0))
    m = np.array([scaled(d) for d in days])
    m[:, list(drop)] = 0.0
    mean = np.average(y, weights=w)
    noise = max(np.average((y - mean) ** 2, weights=w) / max(np.abs(y).max(), 1e-9) ** 2, 1e-9)
    penalty = np.diag([noise / 25.0] + [1.0] * (m.shape[1] - 1))
    beta = np.linalg.solve(m.T @ (m * w[:, None]) + penalty, m.T @ (w * y))
    beta[list(drop)] = 0.0
    return {d: max(float(scaled(d) @ beta), 0.0) for d in predict}


def test_fits_match_one_series_at_a_time(spark):
    """Every model of several series, solved in one stack from shared sums, against
    the plain regression of each."""
    rng = np.random.default_rng(3)
    first = dt.date(2024, 1, 1)
    days = [first + dt.timedelta(days=i) for i in range(160)]
    table = [(d, *[float(v) for v in rng.integers(0, 2, len(fc.FEATURES) - 1)], float(rng.normal(30, 5))) for d in days]
    design = spark.createDataFrame(table, "ds date, " + ", ".join(f"{f} double" for f in fc.FEATURES))
    features = {r[0]: r[1:] for r in table}
    rows = []
    for user, n in ((1, 120), (2, 9), (3, 1), (4, 60)):
        picked = sorted(rng.choice(120, n, replace=False).tolist())
        rows += [(user, days[i], int(rng.integers(0, 50)) + (200 if i % 7 == 5 else 0), bool(rng.integers(0, 2)), days[130]) for i in picked]
    history = spark.createDataFrame(rows, "user_id int, ds date, y long, is_imputed boolean, until date").repartition(3)
    cutoff = str(days[70])
    models = [fit.Model("full", days="span"), fit.Model("early", cutoff, days="after", horizon=20), fit.Model("solid", cutoff, robust=True, days="after", horizon=20),
              fit.Model("plain", cutoff, drop="holidays", days="after", horizon=5), fit.Model("part", part=0.8)]
    got = {(r.user_id, r.model, r.ds): r.yhat for r in fit.fit(history, ["user_id"], design, models).collect()}
    gone = [1 + fc.FEATURES.index(f) for f in calendar.HOLIDAY_KEYS]
    after = lambda n: [days[71 + i] for i in range(n)]
    for user in (1, 2, 3, 4):
        own = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == user]
        early = [r for r in own if r[1] <= days[70]]
        usual = {w: np.median([r[2] for r in early if r[1].weekday() == w]) for w in {r[1].weekday() for r in early}}
        solid = [r for r in early if r[2] >= usual[r[1].weekday()] * 0.3]
        span = [own[0][1] + dt.timedelta(days=i) for i in range((days[130] - own[0][1]).days + 1)]
        for name, train, predict, drop in (("full", own, span, ()), ("early", early, after(20), ()), ("solid", solid, after(20), ()),
                                           ("plain", early, after(5), gone), ("part", own[:int(len(own) * 0.8)], [r[1] for r in own], ())):
            y, w = np.array([float(r[2]) for r in train]), np.array([1.0 if r[3] else 3.0 for r in train])
            want = plain_fit(features, [r[1] for r in train], y, w, predict, drop) if train else dict.fromkeys(predict, 0.0)
            mine = {d: v for (u, m, d), v in got.items() if (u, m) == (user, name)}
            assert mine.keys() == want.keys() and all(abs(mine[d] - want[d]) <= 6e-4 for d in want), (user, name)


def test_dates_outside_the_calendar_stop_the_job(spark):
    inside = spark.createDataFrame([(dt.date(1970, 5, 1),), (dt.date(2060, 5, 1),), (None,)], "ds date")
    assert [r.occasion for r in calendar.with_calendar(inside, ["occasion"]).orderBy("ds").collect()] == [None, "Post-payday spending", "Post-payday spending"]
    with pytest.raises(Exception, match="the calendar covers"):
        calendar.with_calendar(spark.createDataFrame([(dt.date(2090, 5, 1),)], "ds date"), ["occasion"]).collect()
    starts = calendar.calendar(spark).agg(F.min("ds").alias("a"), F.max("ds").alias("b")).first()
    assert (starts.a, starts.b) == calendar.covered()
