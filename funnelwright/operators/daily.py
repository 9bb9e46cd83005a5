"""Daily metric and its day-over-day change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_metric(df: DataFrame, date: str, metric: Column | str) -> DataFrame:
    """Row count and average of the metric per date."""
    return df.groupBy(F.col(date).alias("trans_dt")).agg(
        F.count(F.lit(1)).alias("txn_cnt"), F.avg(metric).alias("avg_metric")
    )


def with_delta(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average minus the previous day's average; null on the first day of a group.

    The input has one row per day and group. Without ``by`` the window is one partition of
    as many rows as there are days.
    """
    keys = [F.col(c) for c in by] or [F.lit(0)]
    window = Window.partitionBy(*keys).orderBy("trans_dt")
    return daily.withColumn("metric_delta", F.col("avg_metric") - F.lag("avg_metric").over(window))


def daily_metrics(df: DataFrame, date: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Per date and metric name: row count, number and sum of values, average; one scan for all metrics."""
    aggregates = [F.count(F.lit(1)).alias("txn_cnt")]
    for position, column in enumerate(metrics.values()):
        aggregates += [F.count(column).alias(f"n{position}"), F.sum(column).alias(f"s{position}")]
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"n{position}").alias("value_cnt"),
                F.col(f"s{position}").cast("double").alias("value_sum"),
            )
            for position, name in enumerate(metrics)
        ]
    )
    wide = df.groupBy(F.col(date).alias("trans_dt")).agg(*aggregates)
    long = wide.select("trans_dt", "txn_cnt", F.inline(items))
    average = F.when(F.col("value_cnt") > 0, F.col("value_sum") / F.col("value_cnt"))
    return long.withColumn("avg_metric", average)


def days_of(df: DataFrame, start: str, end: str, keep: Sequence[str], date: str = "trans_dt") -> DataFrame:
    """One row per day of each row's window, so that windows join on an equal date."""
    days = F.when(F.col(start) <= F.col(end), F.sequence(F.col(start), F.col(end)))
    return df.select(*keep, F.explode(days).alias(date))
