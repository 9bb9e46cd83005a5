"""Numeric, date and window expressions shared by the jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_date(value: dt.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def in_dates(date: Column | str, start: dt.date | str | Column, end: dt.date | str | Column) -> Column:
    """Inclusive date range."""
    return (F.col(date) if isinstance(date, str) else date).between(as_date(start), as_date(end))


def safe_double(c: Column | str) -> Column:
    """Number, or null for null, '' and text that is not a number."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def pct_change(value: Column, baseline: Column) -> Column:
    """(value - baseline) / baseline; null without a value or with a null or zero baseline."""
    return F.when(baseline != 0, (value - baseline) / baseline)


def percent_text(x: Column) -> Column:
    """``0.12345`` -> ``12.35%`` (two decimals, ties to even on the exact binary value).

    ``format_string`` rounds the shortest decimal form half up instead, which differs on
    values such as 10.125. The fraction of a double is a whole number of 2^-52 parts from
    1 upwards, so the rounding is done on whole numbers.
    """
    y = F.abs(x * 100)
    whole = F.floor(y)
    parts = ((y - whole) * F.lit(float(2**52))).cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    unit, half = F.lit(2**52).cast("decimal(20,0)"), F.lit(2**51).cast("decimal(20,0)")
    low = F.floor(parts / unit).cast("bigint")
    rest = parts - low.cast("decimal(10,0)") * unit
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    cents = whole.cast("bigint") * 100 + low + up.cast("bigint")
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("%"))


def age_in_days(date: Column | str, reference: dt.date | str = "2021-01-01") -> Column:
    """Days from the date to the reference date; negative after it."""
    return F.datediff(as_date(reference), F.col(date) if isinstance(date, str) else date)


def lookback_dates(start: dt.date | str) -> dict[str, dt.date]:
    """Start dates 10 and 30 days back; the second keeps its historical name ``start_dt_20``."""
    start = dt.date.fromisoformat(str(start))
    return {"start_dt_10": start - dt.timedelta(days=10), "start_dt_20": start - dt.timedelta(days=30)}


def derive_windows(df: DataFrame, alert_date: str = "alert_date") -> DataFrame:
    """Add analysis and baseline windows; stated start/end columns of the same names win.

    end = alert date, start = end - 2 days, baseline end = start - 1 day,
    baseline start = baseline end - 27 days, all inclusive.
    """

    def stated(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast("date"), default) if name in df.columns else default

    df = df.withColumn("end_date", stated("end_date", F.col(alert_date)))
    df = df.withColumn("start_date", stated("start_date", F.date_sub("end_date", 2)))
    df = df.withColumn("baseline_end_date", stated("baseline_end_date", F.date_sub("start_date", 1)))
    return df.withColumn("baseline_start_date", stated("baseline_start_date", F.date_sub("baseline_end_date", 27)))
