"""Daily history of the metric behind each alert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelwright.operators.catalog import resolve
from funnelwright.operators.daily import daily_metrics, days_of, with_delta
from funnelwright.plans.alert_rca import SHOWN, parsed_requests
from funnelwright.sources.batch import QueryRun, run_queries, run_statements

# Where the SQL of an answer comes from.
CUSTOM_SQL, TEMPLATE = "llm_query", "fallback_template"


def alert_requests(alerts: DataFrame, metadata: DataFrame, today: str | None = None) -> DataFrame:
    """Alerts with the table, metric column and window their daily history is read from.

    Stated columns win over resolved ones: variable_id, variable_name, alert_table,
    alert_date, start_date, end_date, sql_query. The window defaults to the alert day.
    Several candidates, or no variable at all, give ``needs_user_input``.
    """
    resolved = resolve(parsed_requests(alerts, today), metadata, "variable_reference", SHOWN)

    def first(*candidates: Column | str) -> Column:
        columns = [F.col(c) if isinstance(c, str) else c for c in candidates]
        return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns], F.lit(""))

    def stated(name: str) -> Column:
        return F.col(name).cast("string") if name in resolved.columns else F.lit("")

    variable = first(stated("stated_variable_id"), F.col("metadata.variable_id"), "variable_reference")
    column = first(stated("stated_variable_name"), F.col("metadata.variable_name"), variable)
    custom = first(stated("sql_query"))
    status = F.when((F.col("resolution") == "ambiguous") | (variable == ""), "needs_user_input").otherwise("success")
    day = F.col("alert_date")

    def date_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("date"), day) if name in resolved.columns else day

    return resolved.select(
        "alert_id",
        status.alias("status"),
        variable.alias("resolved_id"),
        column.alias("metric"),
        first(stated("alert_table"), F.col("metadata.source_table")).alias("table_name"),
        "alert_date",
        date_of("start_date").alias("start_date"),
        date_of("end_date").alias("end_date"),
        "alert_type",
        "metric_view",
        custom.alias("sql_query"),
        F.when(custom != "", CUSTOM_SQL).otherwise(TEMPLATE).alias("sql_source"),
        F.when(F.col("resolution") == "ambiguous", F.col("candidates")).alias("candidates"),
    )


def daily_history(
    requests: DataFrame, tables: Mapping[str, DataFrame], metrics: Mapping[str, Sequence[str]], date: str = "trans_dt"
) -> DataFrame:
    """alert_id, status, trans_dt, txn_cnt, avg_metric, metric_delta: a row per day, one at least per request.

    Each table is scanned once for all its metrics and requests; the day rows then meet the
    requests on table, metric and date. A request without days has one row without a date, whose
    status says why: ``needs_user_input``, ``custom_sql`` (it brings its own statement),
    ``unknown_metric`` (no such table or metric here) or ``no_data``.
    """
    per_table = [
        daily_metrics(tables[name], date, {c: F.col(c) for c in metrics[name]}).withColumn("table_name", F.lit(name))
        for name in tables
    ]
    days = reduce(DataFrame.unionByName, per_table)
    open_requests = requests.where((F.col("status") == "success") & (F.col("sql_source") == TEMPLATE))
    wanted = days_of(open_requests, "start_date", "end_date", ["alert_id", "table_name", "metric"])
    found = wanted.join(days, ["table_name", "metric", "trans_dt"])
    history = with_delta(found.select("alert_id", "trans_dt", "txn_cnt", "avg_metric"), ["alert_id"])
    known = reduce(
        Column.__or__, [(F.col("table_name") == name) & F.col("metric").isin(list(metrics[name])) for name in tables]
    )
    empty = (
        F.when(F.col("status") != "success", F.col("status"))
        .when(F.col("sql_source") != TEMPLATE, "custom_sql")
        .when(known, "no_data")
        .otherwise("unknown_metric")
    )
    asked = requests.select("alert_id", empty.alias("without_days")).distinct()
    return asked.join(history, "alert_id", "left").select(
        "alert_id",
        F.when(F.col("trans_dt").isNotNull(), "success").otherwise(F.col("without_days")).alias("status"),
        "trans_dt", "txn_cnt", "avg_metric", "metric_delta",
    )


def run_custom_sql(spark: SparkSession, statements: Mapping[str, str]) -> list[QueryRun]:
    """Run the caller's own SQL, keyed by alert, instead of the daily template."""
    return run_queries(spark, [(f"alert_rationalization_{alert}", sql) for alert, sql in statements.items()])


def custom_results(requests: DataFrame) -> DataFrame:
    """alert_id, status, row_count, error, row: what the requests' own statements gave, joined to the requests.

    A statement without rows, or one that failed, has one row without ``row``.
    """
    own = requests.where(F.col("sql_source") == CUSTOM_SQL).select("alert_id", F.col("sql_query").alias("sql"))
    results, rows = run_statements(own)
    return results.join(rows, "alert_id", "left")
