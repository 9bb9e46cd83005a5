"""Data-quality checks computed from the tables behind an alert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.operators.daily import days_of

#: A share of rows without a key above the first fails, and so do rows a day below the second
#: part of the baseline's, a day of the window without rows, or rows missing or late by more days.
NULL_LIMIT, ROWS_LIMIT, LAG_LIMIT = 0.01, 0.5, 0


@dataclass(frozen=True)
class Profiled:
    """A table with its key columns, its day column and, if it has one, the time a row came in."""

    rows: DataFrame
    keys: Sequence[str]
    date: str = "trans_dt"
    loaded: str | None = None


def daily_profile(tables: Mapping[str, Profiled], days: Column | None = None) -> DataFrame:
    """(table_name, trans_dt, n_rows, null_rows, late_days): one pass over each table.

    ``null_rows`` lack one of the keys at least; ``late_days`` is the longest time from a row's day to
    its loading, null without such a column. ``days`` is a condition on trans_dt.
    """
    parts = []
    for name, table in tables.items():
        missing = reduce(Column.__or__, [F.col(k).isNull() for k in table.keys], F.lit(False))
        late = F.datediff(table.loaded, "trans_dt") if table.loaded else F.lit(None).cast("int")
        rows = table.rows.withColumn("trans_dt", F.col(table.date).cast("date"))
        rows = rows if days is None else rows.where(days)
        counted = rows.groupBy("trans_dt").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("null_rows"), F.max(late).alias("late_days")
        )
        parts.append(counted.select(F.lit(name).alias("table_name"), "trans_dt", "n_rows", "null_rows", "late_days"))
    return reduce(DataFrame.unionByName, parts)


def window_checks(profile: DataFrame, pairs: DataFrame, tables: Sequence[str], by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """The three checks for every pair of windows: (by..., position, name, status, details).

    ``pairs`` has ``by`` and the four window dates. A check fails if one of the tables does; a table
    without a row in either window makes a check ``unknown`` if none fails. The details name every table.
    """
    ends = {"current": ("start_date", "end_date"), "baseline": ("baseline_start_date", "baseline_end_date")}
    days = reduce(
        DataFrame.unionByName,
        [days_of(pairs, start, end, by).withColumn("role", F.lit(role)) for role, (start, end) in ends.items()],
    )

    def of(role: str, column: str = "n_rows") -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, F.col(column))), F.lit(0))

    current_day = F.when(F.col("role") == "current", F.col("trans_dt"))
    found = days.join(profile, "trans_dt").groupBy(*by, "table_name").agg(
        of("current").alias("n"), of("current", "null_rows").alias("nulls"), of("baseline").alias("n_before"),
        F.count(current_day).alias("days"), F.count_if(F.col("role") == "baseline").alias("days_before"),
        F.max(current_day).alias("last_day"), F.max(F.when(F.col("role") == "current", F.col("late_days"))).alias("late"),
    )
    every = pairs.select(*by, *[d for pair in ends.values() for d in pair], F.explode(F.array(*map(F.lit, sorted(tables)))).alias("table_name"))
    known = every.join(found, [*by, "table_name"], "left").na.fill(0, ["n", "nulls", "n_before", "days", "days_before"])
    length = {role: F.datediff(end, start) + 1 for role, (start, end) in ends.items()}
    behind = F.coalesce(F.datediff("end_date", "last_day"), length["current"])
    late = F.greatest(behind, F.coalesce("late", F.lit(0)))
    any_row = (F.col("n") > 0) | (F.col("n_before") > 0)
    # Rows a day are compared as products, so that nothing is rounded.
    few = F.col("n") * length["baseline"] < F.col("n_before") * length["current"] * ROWS_LIMIT
    text = lambda *c: F.concat(F.col("table_name"), F.lit(": "), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    checks = [
        ("missing_key_fields", F.col("nulls") > F.col("n") * NULL_LIMIT, text(F.col("nulls"), " of ", F.col("n"), " rows")),
        (
            "row_count_gap",
            (F.col("days") < length["current"]) | few,
            text(F.col("n"), " rows on ", F.col("days"), " of ", length["current"], " days, before ",
                 F.col("n_before"), " on ", F.col("days_before"), " of ", length["baseline"]),
        ),
        ("ingestion_lag", late > LAG_LIMIT, text(late, " days")),
    ]
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), (bad & any_row).alias("bad"), said.alias("said"))
        for i, (name, bad, said) in enumerate(checks)
    ]
    judged = known.select(*by, "table_name", any_row.alias("any_row"), F.inline(F.array(*items)))
    status = F.when(F.bool_or("bad"), "fail").when(F.bool_and("any_row"), "pass").otherwise("unknown")
    details = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "said"))), lambda x: x["said"]), "; ")
    return judged.groupBy(*by, "position", "name").agg(status.alias("status"), details.alias("details"))
