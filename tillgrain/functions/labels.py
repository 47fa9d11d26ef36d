"""Labels of a date or an hour as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label sets and their display order.
PERIODS = ("morning", "Afternoon", "Evening", "night")
SEASONS = ("Winter", "Spring", "Summer", "Autumn")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
OPEN_HOURS = tuple(range(6, 24)) + (0, 1, 2)
FALLBACK_HOURS = {"morning": 10, "afternoon": 14, "evening": 18, "night": 22}
FALLBACK_HOUR = 12
CLASSES = ("Star", "Plowhorse", "Puzzle", "Dog")


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """1-based place of a label in its display order, 0 when unknown."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), value).cast("int")


def is_blank(value: Column) -> Column:
    """NULL, empty, or one of the words a spreadsheet export leaves behind."""
    return F.coalesce(F.lower(F.trim(value)).isin("", "nan", "none", "null"), F.lit(True))


def time_period(hour: Column) -> Column:
    return (
        F.when(hour.isNull(), F.lit(None).cast("string"))
        .when(hour.between(5, 11), "morning")
        .when(hour.between(12, 16), "Afternoon")
        .when(hour.between(17, 21), "Evening")
        .otherwise("night")
    )


def _season(month: Column, spring: tuple[int, ...], summer: tuple[int, ...]) -> Column:
    return (
        F.when(month.isNull(), F.lit(None).cast("string"))
        .when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(*spring), "Spring")
        .when(month.isin(*summer), "Summer")
        .otherwise("Autumn")
    )


def season_met(ds: Column) -> Column:
    """Meteorological season, used for enrichment and imputation."""
    return _season(F.month(ds), (3, 4, 5), (6, 7, 8))


def season_local(ds: Column) -> Column:
    """Demand-calibrated season, used by the forecast."""
    return _season(F.month(ds), (3, 4), (5, 6, 7, 8, 9))


def is_payday(ds: Column) -> Column:
    day = F.dayofmonth(ds)
    return (day >= 27) | (day <= 5)


def dow(ds: Column) -> Column:
    """Weekday number, Monday = 0."""
    return F.weekday(ds).cast("int")


def day_name(ds: Column) -> Column:
    return F.date_format(ds, "EEEE")


def occasion(ds: Column, hijri_month: Column, hijri_day: Column) -> Column:
    """The one label with the highest priority for a date."""
    day, month = F.dayofmonth(ds), F.month(ds)
    return (
        F.when(hijri_month == 9, "Ramadan")
        .when((hijri_month == 10) & (hijri_day <= 3), "Eid al-Fitr")
        .when((hijri_month == 12) & hijri_day.between(10, 13), "Eid al-Adha")
        .when((month == 9) & (day == 23), "Saudi National Day")
        .when((month == 2) & (day == 22), "Saudi Founding Day")
        .when(day == 27, "Payday")
        .when(is_payday(ds), "Post-payday spending")
        .when(F.weekday(ds).isin(4, 5), "Weekend")
        .otherwise("Normal Day")
    )


def occasion_family(label: Column) -> Column:
    return (
        F.when(label.isin("Eid al-Fitr", "Eid al-Adha"), "Eid")
        .when(label.isin("Saudi National Day", "Saudi Founding Day"), "Solar holiday")
        .when(label == "Ramadan", "Ramadan")
        .when(label == "Payday", "Payday anchor")
        .when(label == "Post-payday spending", "Post-payday")
        .when(label == "Weekend", "Weekend (Fri/Sat)")
        .otherwise("Normal")
    )


def hour_label(hour: Column) -> Column:
    """12-hour clock label such as ``9AM``."""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.when(hour < 12, "AM").otherwise("PM"))
