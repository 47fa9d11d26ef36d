"""Calendar dimension: Hijri dates, labels, holidays and weather."""

from __future__ import annotations

import datetime as dt
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tillgrain.functions import labels
from tillgrain.functions.tables import values

#: Hijri years the calendar covers by default (June 1960 to March 2068)
HIJRI_YEARS = (1380, 1490)
HOLIDAY_PADDING = 35

# Holiday, days after the anchor it starts at, last day offset of its window.
RAMADAN_WINDOW = 28
BOUNCE_WINDOW = 3
PAYDAY_WINDOW = 4
HOLIDAY_KEYS = (
    [f"ramadan_{i}" for i in range(29)]
    + ["eid_fitr_day1_0"] + [f"eid_fitr_bounce_{i}" for i in range(4)]
    + ["eid_adha_day1_0"] + [f"eid_adha_bounce_{i}" for i in range(4)]
    + ["saudi_national_day_0", "saudi_founding_day_0"]
    + [f"payday_late_{i}" for i in range(5)] + [f"payday_early_{i}" for i in range(5)]
)

# WMO weather codes in use.
WMO_CODES = [
    (0, "Clear Sky"), (1, "Mainly Clear"), (2, "Partly Cloudy"), (3, "Overcast"),
    (51, "Light Drizzle"), (53, "Moderate Drizzle"), (55, "Dense Drizzle"),
    (61, "Slight Rain"), (63, "Moderate Rain"), (65, "Heavy Rain"), (95, "Thunderstorm"),
]
DEFAULT_TEMP = 28.0


_MONTHS: WeakKeyDictionary = WeakKeyDictionary()


def hijri_months(spark: SparkSession, first: int = HIJRI_YEARS[0], last: int = HIJRI_YEARS[1]) -> DataFrame:
    """Umm al-Qura month starts from the JVM's own calendar: one row per month,
    with the start of the next month. 12 rows per year, so always small; built
    once per session."""
    known = _MONTHS.setdefault(spark, {})
    if (first, last) not in known:
        of = spark._jvm.java.time.chrono.HijrahDate.of
        epoch = dt.date(1970, 1, 1)
        months = [(y, m) for y in range(first, last + 1) for m in range(1, 13)] + [(last + 1, 1)]
        starts = [epoch + dt.timedelta(days=of(y, m, 1).toEpochDay()) for y, m in months]
        table = pa.table({"hijri_month": pa.array([m for _, m in months[:-1]], pa.int32()), "month_start": starts[:-1], "next_start": starts[1:]})
        known[first, last] = spark.createDataFrame(table)
    return known[first, last]


def calendar(spark: SparkSession, first: int = HIJRI_YEARS[0], last: int = HIJRI_YEARS[1]) -> DataFrame:
    """One row per day with every label. Days are unrolled from the month table,
    so finding a date's Hijri month is no range join but an equi-join on ``ds``.
    The row count is fixed by the year span (about 39,000), which is what makes
    broadcasting it safe at any data size."""
    days = hijri_months(spark, first, last).select(
        "hijri_month",
        "month_start",
        F.explode(F.sequence("month_start", F.date_sub("next_start", 1))).alias("ds"),
    )
    ds = F.col("ds")
    hijri_day = (F.datediff(ds, "month_start") + 1).cast("int")
    return days.select(
        "ds",
        "hijri_month",
        hijri_day.alias("hijri_day"),
        labels.season_local(ds).alias("season"),
        labels.season_met(ds).alias("season_met"),
        labels.dow(ds).alias("dow"),
        labels.is_payday(ds).alias("is_payday"),
        labels.occasion(ds, F.col("hijri_month"), hijri_day).alias("occasion"),
    )


# First day of the first and last day of the last year of HIJRI_YEARS.
COVERED = (dt.date(1960, 6, 26), dt.date(2068, 3, 4))


def covered() -> tuple[dt.date, dt.date]:
    """First and last day the calendar has labels for."""
    return COVERED


def with_calendar(df: DataFrame, columns: list[str], on: str = "ds") -> DataFrame:
    """Left join of calendar columns on a date column. A date that the calendar
    does not cover stops the job: it has labels, the table just lacks them."""
    first, last = COVERED
    inside = F.col(on).isNull() | F.col(on).between(F.lit(first), F.lit(last))
    said = F.concat(F.lit(f"the calendar covers {first} to {last}, not "), F.col(on).cast("string"))
    cal = calendar(df.sparkSession).select(F.col("ds").alias(on), *columns)
    checked = df.withColumn(on, F.when(inside, F.col(on)).otherwise(F.raise_error(said).cast("date")))
    return checked.join(F.broadcast(cal), on, "left")


def spine(bounds: DataFrame, start: str | Column, end: str | Column, keys: list[str] | None = None) -> DataFrame:
    """Dense daily dates from ``start`` to ``end`` of every row of ``bounds``."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return bounds.select(*(keys or []), F.explode(F.sequence(start, end)).alias("ds"))


def date_bounds(sales: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return sales.groupBy(*(keys or [])).agg(
        F.min("order_date").alias("first_ds"), F.max("order_date").alias("last_ds")
    )


def holidays(spark: SparkSession, bounds: DataFrame) -> DataFrame:
    """Holiday events with their windows for the padded date span of ``bounds``
    (one row: ``first_ds``, ``last_ds``)."""
    days = spine(
        bounds,
        F.date_sub("first_ds", HOLIDAY_PADDING),
        F.date_add("last_ds", HOLIDAY_PADDING),
    )
    cal = with_calendar(days, ["hijri_month", "hijri_day"])
    month, day = F.month("ds"), F.dayofmonth("ds")
    hijri = lambda m, d: (F.col("hijri_month") == m) & (F.col("hijri_day") == d)

    def event(test: Column, name: str, shift: int, upper: int) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(name).alias("holiday"),
                F.date_add("ds", shift).alias("ds"),
                F.lit(0).alias("lower_window"),
                F.lit(upper).alias("upper_window"),
            ),
        )

    events = F.array_compact(F.array(
        event(hijri(9, 1), "ramadan", 0, RAMADAN_WINDOW),
        event(hijri(10, 1), "eid_fitr_day1", 0, 0),
        event(hijri(10, 1), "eid_fitr_bounce", 1, BOUNCE_WINDOW),
        event(hijri(12, 10), "eid_adha_day1", 0, 0),
        event(hijri(12, 10), "eid_adha_bounce", 1, BOUNCE_WINDOW),
        event((month == 9) & (day == 23), "saudi_national_day", 0, 0),
        event((month == 2) & (day == 22), "saudi_founding_day", 0, 0),
        event(day == 27, "payday_late", 0, PAYDAY_WINDOW),
        event(day == 1, "payday_early", 0, PAYDAY_WINDOW),
    ))
    return cal.select(F.inline(events))


def holiday_days(events: DataFrame) -> DataFrame:
    """Every event unrolled over its window: (ds, holiday, offset, key)."""
    unrolled = events.select(
        "holiday",
        F.col("ds").alias("anchor"),
        F.explode(F.sequence(F.date_add("ds", F.col("lower_window")), F.date_add("ds", F.col("upper_window")))).alias("ds"),
    )
    offset = F.datediff("ds", "anchor").cast("int")
    return unrolled.select(
        "ds", "holiday", offset.alias("day_offset"),
        F.concat_ws("_", "holiday", offset.cast("string")).alias("key"),
    ).distinct()


def holiday_matrix(days: DataFrame) -> DataFrame:
    """One indicator column per (holiday, offset), one row per holiday date."""
    flag = lambda k: F.max(F.when(F.col("key") == k, 1).otherwise(0)).cast("int").alias(k)
    return days.groupBy("ds").agg(*[flag(k) for k in HOLIDAY_KEYS])


def notable_events(days: DataFrame) -> DataFrame:
    """All labels of a date: the primary one unless it is a normal day, and the
    payday label where another occasion hides it."""
    cal = with_calendar(days, ["occasion"])
    day, primary = F.dayofmonth("ds"), F.col("occasion")
    payday = F.when(day == 27, "Payday").when((day >= 28) | (day <= 5), "Post-payday spending")
    tags = F.array_compact(F.array(
        F.when(primary != "Normal Day", primary),
        F.when(payday != primary, payday),
    ))
    return cal.select("ds", F.explode(tags).alias("event"))


def regressors(days: DataFrame) -> DataFrame:
    return with_calendar(days, ["season", "occasion"])


def islands(days: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive dates of one label become one event. ``days`` holds distinct
    dates per key, so a window never exceeds the calendar's length."""
    w = Window.partitionBy(*keys).orderBy("ds")
    return days.withColumn("island", F.date_sub("ds", F.row_number().over(w)))


def one_hot_season(days: DataFrame) -> DataFrame:
    flags = {f"season_{s}": (F.col("season") == s).cast("int") for s in labels.SEASONS}
    return with_calendar(days, ["season"]).withColumns(flags)


# -- weather ---------------------------------------------------------------


def daily_temperature(days: DataFrame, weather: DataFrame) -> DataFrame:
    """Observed maximum, else the mean of the same month-day over the observed
    years, else NULL. Both lookups hold at most one row per date."""
    climate = weather.groupBy(F.date_format("ds", "MM-dd").alias("month_day")).agg(
        F.avg("temp_max").alias("climate")
    )
    return (
        days.withColumn("month_day", F.date_format("ds", "MM-dd"))
        .join(weather.select("ds", "temp_max"), "ds", "left")
        .join(climate, "month_day", "left")
        .withColumn("temp_max", F.coalesce("temp_max", "climate"))
        .drop("month_day", "climate")
    )


def fill_temperature(days: DataFrame) -> DataFrame:
    """Gaps take the mean of the present values; 28 when there are none."""
    mean = days.agg(F.avg("temp_max").alias("mean_temp"))
    return (
        days.crossJoin(F.broadcast(mean))
        .withColumn("temp_max", F.coalesce("temp_max", "mean_temp", F.lit(DEFAULT_TEMP)))
        .drop("mean_temp")
    )


def weather_condition(weather: DataFrame) -> DataFrame:
    """WMO code to text, unknown codes as ``Code n``."""
    codes = values(weather.sparkSession, WMO_CODES, "weather_code int, text string")
    return weather.join(F.broadcast(codes), "weather_code", "left").select(
        *[c for c in weather.columns],
        F.coalesce("text", F.concat(F.lit("Code "), F.col("weather_code").cast("string"))).alias("weather_condition"),
    )
