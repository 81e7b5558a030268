"""Dates, bucket labels and percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = ("hour", "day", "week")


def bucket_label(ts: Column, interval: str = "day") -> Column:
    """Label of the hour, day or week of a timestamp; a week is its Monday with its number, the first Monday's being 01."""
    if interval == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if interval == "week":
        monday = F.date_trunc("week", ts)
        number = F.lpad((F.floor((F.dayofyear(monday) - 1) / 7) + 1).cast("string"), 2, "0")
        return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit(" (W"), number, F.lit(")"))
    return F.date_format(ts, "yyyy-MM-dd")


def first_of_month(year: Column, month: Column) -> Column:
    """Null for a month that there is not."""
    return F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def day_month_year(day: Column, month: Column, year: Column) -> Column:
    return F.concat(F.lpad(day.cast("string"), 2, "0"), F.lit("/"), F.lpad(month.cast("string"), 2, "0"), F.lit("/"), F.lpad(year.cast("string"), 4, "0"))
