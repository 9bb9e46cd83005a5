"""Root-cause analysis of a table of alerts: parse, resolve, measure, explain."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelwright.functions.measures import derive_windows, in_dates
from funnelwright.functions.text import normalize_token, parse_structured_alerts
from funnelwright.operators.catalog import resolve
from funnelwright.operators.daily import daily_metrics, days_of
from funnelwright.operators.drivers import (
    CHANGE_FIELDS,
    DIMENSION_COLUMNS,
    driver_package,
    segment_changes,
    segment_counts,
    top_per_dimension,
)
from funnelwright.operators.funnel import FunnelRules, FunnelTables, counts_from_cells, funnel_cells
from funnelwright.operators.quality import Profiled, daily_profile, window_checks
from funnelwright.operators.rca import (
    CHECKS_TYPE,
    OBSERVED,
    check_records,
    default_checks,
    empty_diagnostics,
    empty_drivers,
    packaged,
    rca_package,
    stage_diagnostics,
)
from funnelwright.operators.sampling import join_labels
from funnelwright.sources.batch import run_statements
from funnelwright.sources.tables import cut_lineage

WINDOW_FIELDS = ["start_date", "end_date", "baseline_start_date", "baseline_end_date"]


@dataclass(frozen=True)
class RcaTables:
    """What the findings are computed from; every part is optional.

    funnel: the funnel inputs. driver_rows: one row per transaction with trans_dt, the
    dimension columns and the amount. metric_rows: rows with trans_dt and the ``metrics``
    columns, keyed by variable id or hint name. checks: supplied data-quality checks. profiled:
    tables that the computed checks look at.
    """

    funnel: FunnelTables | None = None
    rules: FunnelRules = field(default_factory=FunnelRules)
    driver_rows: DataFrame | None = None
    dimensions: Mapping[str, Column] = field(default_factory=dict)
    amount: Column | None = None
    metric_rows: DataFrame | None = None
    metrics: Mapping[str, Column] = field(default_factory=dict)
    checks: DataFrame | None = None
    profiled: Mapping[str, Profiled] = field(default_factory=dict)


#: Ranges of days that a scan is filtered by at most; beyond, the nearest ones are joined.
MOST_RANGES = 64
#: Segments shown of those that changed most.
CHANGES_SHOWN = 5
#: Candidates shown of an ambiguous reference.
SHOWN = 10
#: Rows of segments and windows that a task sums, about.
ROWS_A_PART = 1_000_000


def parsed_requests(alerts: DataFrame, today: str | None = None) -> DataFrame:
    """Alerts parsed; a stated variable id, else a stated name, is the reference even beside free text.

    The stated texts stay as ``stated_variable_id`` and ``stated_variable_name``. Alerts are dealt out
    before they are parsed, which takes far longer than to read them: a file can be a few large splits.
    """
    stated = {
        f"stated_{c}": F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in alerts.columns else F.lit(None).cast("string")
        for c in ("variable_id", "variable_name")
    }
    parsed = parse_structured_alerts(alerts.repartition("alert_id").withColumns(stated), today)
    return parsed.withColumn("variable_reference", F.coalesce(*stated, "variable_reference"))


def resolved_alerts(alerts: DataFrame, metadata: DataFrame, today: str | None = None) -> DataFrame:
    """Alerts parsed, resolved against the metadata sheet, with status and windows.

    ``alerts``: alert_id plus ``user_query`` or structured columns. Status is ``success``,
    ``needs_user_input`` (several candidates) or ``not_found``. Stated window columns win.
    """
    resolved = resolve(parsed_requests(alerts, today), metadata, "variable_reference", SHOWN)
    status = (
        F.when(F.col("resolution") == "resolved", "success")
        .when(F.col("resolution") == "ambiguous", "needs_user_input")
        .otherwise("not_found")
    )
    return derive_windows(resolved.withColumn("status", status))


def alert_windows(alerts: DataFrame) -> DataFrame:
    """alert_id, role (current, baseline), window_id, start_date, end_date."""
    rows = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(s).alias("start_date"), F.col(e).alias("end_date"))
            for role, s, e in (
                ("current", "start_date", "end_date"),
                ("baseline", "baseline_start_date", "baseline_end_date"),
            )
        ]
    )
    long = alerts.select("alert_id", F.inline(rows))
    return long.withColumn("window_id", F.concat_ws("_", "start_date", "end_date"))


def _window_id(role: str) -> Column:
    """The id that ``alert_windows`` gives the current or the baseline window."""
    before = "baseline_" if role == "baseline" else ""
    return F.concat_ws("_", f"{before}start_date", f"{before}end_date").alias(role)


def _days_scanned(windows: DataFrame, date: str = "trans_dt") -> DataFrame:
    return days_of(windows, "start_date", "end_date", ["window_id", "end_date"], date)


def driver_inputs(tables: FunnelTables) -> tuple[DataFrame, dict[str, Column]]:
    """Rows and dimensions for all keys of a driver package.

    Model and path of an authorization stand in its label, the zero-value flag in the analytics (the
    largest where there are several); both are joined by key and day.
    """
    on = ["cas_pkey", "trans_dt"]
    labels = tables.labels.select(*on, "lift_frd_in", "modl_id", "lift_path_ds")
    flags = tables.analytics.groupBy(*on).agg(F.max("zero_value_auth_ind").alias("zero_value_auth_ind"))
    rows = join_labels(tables.authorizations, labels, on, "lift_frd_in").join(flags, on, "left")
    columns = {
        **DIMENSION_COLUMNS, "approval_code": "appr_deny_cd", "cm15": "cm15",
        "canceled_plastic": "cancl_plastic_cd", "zero_value_auth": "zero_value_auth_ind",
    }
    return rows, {name: F.col(column) for name, column in columns.items()}


def days_covered(windows: DataFrame) -> Column:
    """Filter on trans_dt for the days of the windows, as ranges of literal dates.

    Literals reach the scans as pushed filters and prune date partitions. Windows that touch or
    overlap make one range; of more than MOST_RANGES ranges those with the shortest gaps are joined.
    What comes to the driver is bounded by the number of days there are.
    """
    days = days_of(windows, "start_date", "end_date", []).distinct()
    # One row a day: the window has as many rows as the calendar has days.
    before = F.lag("trans_dt").over(Window.partitionBy(F.lit(0)).orderBy("trans_dt"))
    starts = days.withColumn("before", before).where(F.col("before").isNull() | (F.datediff("trans_dt", "before") > 1))
    borders = sorted((r.trans_dt, r.before) for r in starts.collect())
    if not borders:
        return F.lit(False)
    last = days.agg(F.max("trans_dt")).first()[0]
    gaps = sorted(borders[1:], key=lambda b: b[1] - b[0])[: MOST_RANGES - 1]
    firsts = [borders[0][0], *sorted(start for start, _ in gaps)]
    lasts = [*sorted(end for _, end in gaps), last]
    return reduce(Column.__or__, [in_dates("trans_dt", first, end) for first, end in zip(firsts, lasts)])


def window_stage_counts(
    tables: FunnelTables, rules: FunnelRules, windows: DataFrame, days: Column | None = None
) -> DataFrame:
    """Rows per day of each funnel stage and window, from one scan for all windows."""
    cells = funnel_cells(tables, rules, days_covered(windows) if days is None else days)
    counts = counts_from_cells(cells, windows, rules, ["window_id"])
    length = F.datediff("end_date", "start_date") + 1
    lengths = windows.select("window_id", length.alias("days"))
    return counts.join(lengths, "window_id").select(
        "window_id", "stage", (F.col("row_count") / F.col("days")).alias("rows_per_day")
    )


def window_segments(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Rows and amount of every segment on every day of every window: window_id, dimension, segment_value, cnt, total_amt.

    ``daily``: segments counted per day. ``days``: window_id, trans_dt. A day lies in dozens of windows, so the rows
    are many times those of ``daily``. They are made where all days of a segment lie together, and summing them by window
    and segment needs no shuffle of them. The number of parts follows from that of the rows.
    """
    calendar = days.agg(F.count(F.lit(1)), F.count_distinct("trans_dt")).first()
    parts = 1 + int(daily.count() * calendar[0] / max(calendar[1], 1) / ROWS_A_PART)
    return daily.repartition(parts, "dimension", "segment_value").join(days, "trans_dt").drop("trans_dt")


def window_drivers(segments: DataFrame) -> DataFrame:
    """Driver package per window."""
    counts = segments.groupBy("window_id", "dimension", "segment_value").agg(
        F.sum("cnt").alias("cnt"), F.sum("total_amt").alias("total_amt")
    )
    return driver_package(top_per_dimension(counts, ["window_id"]), ["window_id"])


def window_pairs(alerts: DataFrame) -> DataFrame:
    """Distinct pairs of windows: pair_id and the four dates; many alerts can share one."""
    return alerts.select(_pair_id(), *WINDOW_FIELDS).distinct()


def _pair_id() -> Column:
    return F.concat_ws("_", *WINDOW_FIELDS).alias("pair_id")


def pair_sides(pairs: DataFrame) -> DataFrame:
    """pair_id, role (current, baseline), window_id and its number of days."""
    sides = alert_windows(pairs.withColumnRenamed("pair_id", "alert_id")).withColumnRenamed("alert_id", "pair_id")
    return sides.select("pair_id", "role", "window_id", (F.datediff("end_date", "start_date") + 1).alias("days"))


def found_drivers(tables: RcaTables, pairs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages per window (window_id, top_drivers) and changes per pair of windows (pair_id, driver_changes).

    The segments of all days are counted once and written. Windows and pairs go by numbers until the few segments
    shown are left.
    """
    daily = cut_lineage(segment_counts(tables.driver_rows, tables.dimensions, tables.amount, ["trans_dt"]))
    numbered = cut_lineage(windows.withColumn("window_no", F.monotonically_increasing_id()))
    pair_numbers = pairs.select("pair_id").withColumn("pair_no", F.monotonically_increasing_id())
    window_numbers = numbered.select("window_id", "window_no")
    sides = cut_lineage(pair_sides(pairs).join(window_numbers, "window_id").join(pair_numbers, "pair_id"))
    days = cut_lineage(days_of(numbered, "start_date", "end_date", [F.col("window_no").alias("window_id")]))
    segments = window_segments(daily, days)
    ids = numbered.select(F.col("window_no").alias("window_id"), F.col("window_id").alias("id"))
    packages = cut_lineage(window_drivers(segments).join(ids, "window_id").select(F.col("id").alias("window_id"), "top_drivers"))

    totals = daily.groupBy("trans_dt", "dimension").agg(F.sum("cnt").alias("cnt")).join(days, "trans_dt")
    by_number = sides.select(F.col("pair_no").alias("pair_id"), "role", F.col("window_no").alias("window_id"), "days")
    most = segment_changes(segments.drop("total_amt"), by_number, CHANGES_SHOWN, totals.drop("trans_dt"))
    changed = driver_package(most, ["pair_id"], CHANGE_FIELDS, "driver_changes")
    ids = sides.select(F.col("pair_no"), "pair_id").distinct()
    changed = changed.withColumnRenamed("pair_id", "pair_no").join(ids, "pair_no").select("pair_id", "driver_changes")
    return packages, cut_lineage(changed)


def alert_drivers(alerts: DataFrame, packages: DataFrame, changed: DataFrame) -> DataFrame:
    """alert_id, top_drivers and baseline_drivers (packages of the two windows), driver_changes."""
    long = alert_windows(alerts)
    roles = [
        long.where(F.col("role") == role).join(packages, "window_id").select("alert_id", F.col("top_drivers").alias(name))
        for role, name in (("current", "top_drivers"), ("baseline", "baseline_drivers"))
    ]
    of_alert = alerts.select("alert_id", _pair_id()).join(changed, "pair_id").drop("pair_id")
    return of_alert.join(roles[0], "alert_id", "left").join(roles[1], "alert_id", "left")


def stages_of(sides: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """(by, stage, current, baseline): rows a day of every stage in both windows."""
    return (
        sides.select(by, "role", "window_id")
        .join(counts, "window_id")
        .groupBy(by, "stage")
        .agg(
            F.max(F.when(F.col("role") == "current", F.col("rows_per_day"))).alias("current"),
            F.max(F.when(F.col("role") == "baseline", F.col("rows_per_day"))).alias("baseline"),
        )
    )


def window_metrics(tables: RcaTables, windows: DataFrame) -> DataFrame:
    """Sum and average of every metric per window, from one scan of the metric rows."""
    daily = daily_metrics(tables.metric_rows, "trans_dt", tables.metrics)
    return (
        daily.join(_days_scanned(windows), "trans_dt")
        .groupBy("window_id", normalize_token("metric").alias("metric"))
        .agg(F.sum("value_sum").alias("value_sum"), F.sum("value_cnt").alias("value_cnt"))
        .withColumn("value_avg", F.when(F.col("value_cnt") > 0, F.col("value_sum") / F.col("value_cnt")))
    )


def observed_metrics(alerts: DataFrame, windows: DataFrame, measured: DataFrame) -> DataFrame:
    """The six observed values per alert: the variable's average, its parts' sums per day."""
    meta = F.col("metadata")
    parts = F.array(
        F.struct(F.lit("metric").alias("part"), normalize_token(meta["variable_id"]).alias("metric")),
        F.struct(F.lit("numerator").alias("part"), normalize_token(meta["numerator_hint"]).alias("metric")),
        F.struct(F.lit("denominator").alias("part"), normalize_token(meta["denominator_hint"]).alias("metric")),
    )
    wanted = alerts.select("alert_id", F.inline(parts)).join(
        windows.select("alert_id", "role", "window_id", (F.datediff("end_date", "start_date") + 1).alias("days")),
        "alert_id",
    )
    found = wanted.join(measured, ["window_id", "metric"])
    value = F.when(F.col("part") == "metric", F.col("value_avg")).otherwise(F.col("value_sum") / F.col("days"))

    def pick(part: str, role: str) -> Column:
        return F.max(F.when((F.col("part") == part) & (F.col("role") == role), value))

    names = {
        "metric_value": ("metric", "current"),
        "baseline_value": ("metric", "baseline"),
        "numerator_value": ("numerator", "current"),
        "numerator_baseline": ("numerator", "baseline"),
        "denominator_value": ("denominator", "current"),
        "denominator_baseline": ("denominator", "baseline"),
    }
    return found.groupBy("alert_id").agg(*[pick(*names[c]).alias(c) for c in OBSERVED])


def stated_statements(alerts: DataFrame) -> DataFrame:
    """(alert_id, position, name, sql): the SQL that alerts bring, as ``query`` or in ``queries`` (name, sql).

    Blank texts are left out; an unnamed one is called by its place.
    """
    items = []
    if "query" in alerts.columns:
        items.append(F.array(F.struct(F.lit(0).alias("position"), F.lit("adhoc_query").alias("name"), F.col("query").alias("sql"))))
    if "queries" in alerts.columns:
        named = F.transform(
            F.coalesce("queries", F.array().cast(alerts.schema["queries"].dataType)),
            lambda q, i: F.struct(
                (i + 1).alias("position"),
                F.coalesce(F.nullif(F.trim(q["name"]), F.lit("")), F.concat(F.lit("query_"), (i + 1).cast("string"))).alias("name"),
                q["sql"].alias("sql"),
            ),
        )
        items.append(named)
    listed = alerts.select("alert_id", F.inline(F.concat(*items)))
    return listed.withColumn("sql", F.trim("sql")).where("sql <> ''")


def _measured_by_pair(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """pair_id, measured: a map from the metric to its average and its sum a day, in both windows."""
    values = F.struct(F.col("value_avg").alias("average"), (F.col("value_sum") / F.col("days")).alias("a_day"))
    sides = [F.max(F.when(F.col("role") == role, values)).alias(role) for role in ("current", "baseline")]
    both = pair_sides(pairs).join(measured, "window_id").groupBy("pair_id", "metric").agg(*sides)
    entry = F.struct("metric", F.struct("current", "baseline").alias("sides"))
    return both.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(entry)).alias("measured"))


def _observed(measured: Column) -> dict[str, Column]:
    """The six observed values of an alert, as ``observed_metrics`` gives them, from the map of its pair of windows."""
    fields = {"variable_id": "average", "numerator_hint": "a_day", "denominator_hint": "a_day"}
    values = [
        F.try_element_at(measured, normalize_token(F.col("metadata")[name]))[role][value]
        for name, value in fields.items()
        for role in ("current", "baseline")
    ]
    return dict(zip(OBSERVED, values))


def _of_key(table: DataFrame, key: str) -> DataFrame:
    """Rows by another key than the alert's, for the functions that go by alert_id."""
    return table.withColumnRenamed(key, "alert_id")


def packages_by_pair(
    alerts: DataFrame,
    pairs: DataFrame,
    stages: DataFrame | None,
    drivers: tuple[DataFrame, DataFrame] | None,
    measured: DataFrame | None,
    computed: DataFrame | None,
    supplied: DataFrame | None,
) -> DataFrame:
    """The package of every alert, for alerts that each have an id of their own.

    All findings except the alert's metadata and supplied checks belong to its pair of windows, and many alerts share
    one. They are put together once per pair; the alerts' own columns are all that is shuffled for each of them.
    """
    parts = pairs.select("pair_id", _window_id("current"), _window_id("baseline"))
    if stages is not None:
        listed = stage_diagnostics(_of_key(stages_of(pair_sides(pairs), stages, "pair_id"), "pair_id"))
        parts = parts.join(listed.withColumnRenamed("alert_id", "pair_id"), "pair_id", "left")
    if drivers is not None:
        packages, changed = drivers
        parts = parts.join(changed, "pair_id", "left")
        for role, name in (("current", "top_drivers"), ("baseline", "baseline_drivers")):
            parts = parts.join(packages.select(F.col("window_id").alias(role), F.col("top_drivers").alias(name)), role, "left")
    if measured is not None:
        parts = parts.join(_measured_by_pair(pairs, measured), "pair_id", "left")
    if computed is not None:
        records = check_records(_of_key(computed, "pair_id")).withColumnRenamed("alert_id", "pair_id")
        parts = parts.join(records.withColumnRenamed("data_quality_checks", "computed_checks"), "pair_id", "left")
    parts = cut_lineage(parts.drop("current", "baseline"))

    df = alerts
    if supplied is not None:
        records = check_records(supplied).withColumnRenamed("data_quality_checks", "supplied_checks")
        df = df.join(records, "alert_id", "left")
    df = df.withColumn("pair_id", _pair_id()).join(parts, "pair_id", "left")
    checks = [F.col(c) for c in ("computed_checks", "supplied_checks") if c in df.columns]
    both = F.concat(*[F.coalesce(c, F.array().cast(CHECKS_TYPE)) for c in checks]) if len(checks) == 2 else None
    stages_or_none = [] if stages is None else [F.col("stage_diagnostics")]
    drivers_or_none = [] if drivers is None else [F.col("top_drivers")]
    df = df.withColumns(
        {
            **(dict.fromkeys(OBSERVED, F.lit(None).cast("double")) if measured is None else _observed(F.col("measured"))),
            "stage_diagnostics": F.coalesce(*stages_or_none, empty_diagnostics()),
            "top_drivers": F.coalesce(*drivers_or_none, empty_drivers()),
            "data_quality_checks": F.coalesce(*(checks if both is None else [F.when(F.size(both) > 0, both)]), default_checks()),
        }
    )
    # What stands beside the package is taken along under a key of its own.
    return packaged(df, [] if drivers is None else ["baseline_drivers", "driver_changes"])


def packages_by_alert(
    alerts: DataFrame,
    stages: DataFrame | None,
    drivers: tuple[DataFrame, DataFrame] | None,
    measured: DataFrame | None,
    computed: DataFrame | None,
    supplied: DataFrame | None,
) -> DataFrame:
    """The package of every alert, put together by alert_id: rows of one id share their findings."""
    per_alert = alert_windows(alerts)
    own_stages = None if stages is None else stages_of(per_alert, stages, "alert_id")
    own_drivers = None if drivers is None else cut_lineage(alert_drivers(alerts, *drivers))
    metrics = None if measured is None else observed_metrics(alerts, per_alert, measured)
    checks = supplied
    if computed is not None:
        own = alerts.select("alert_id", _pair_id()).join(computed, "pair_id").drop("pair_id")
        checks = own if supplied is None else own.unionByName(supplied, allowMissingColumns=True)
    package = rca_package(alerts, metrics, own_stages, own_drivers, checks)
    return package if own_drivers is None else package.join(own_drivers.drop("top_drivers"), "alert_id", "left")


def analyze_alerts(alerts: DataFrame, metadata: DataFrame, tables: RcaTables, today: str | None = None) -> DataFrame:
    """One row per alert: status, candidates and, if resolved, the package of findings.

    With driver rows the package also has ``baseline_drivers`` and ``driver_changes``, the segments
    that changed most between the windows; with profiled tables its checks are computed. Alerts that
    bring SQL of their own (``query``, ``queries``) have ``query_results``: name, status, row count and error of
    each statement; ``run_statements(stated_statements(alerts))`` gives the rows as well.
    Each fact table is scanned once for all alerts together: counts are kept per day and
    summed over the windows of the alerts afterwards. Baselines are per-day averages, so a
    3-day window compares with a 28-day one. The resolved alerts are written once to the
    shared folder, because every branch starts from them. Findings are made per window and pair of windows;
    each alert meets those of its pair. Alerts that share an id share their findings, by joins on the id.
    """
    known = cut_lineage(resolved_alerts(alerts, metadata, today))
    good = known.where(F.col("status") == "success")
    pairs = cut_lineage(window_pairs(good))
    windows = cut_lineage(alert_windows(_of_key(pairs, "pair_id")).select("window_id", "start_date", "end_date").distinct())

    days = days_covered(windows)
    stages = drivers = measured = computed = None
    if tables.funnel is not None:
        stages = cut_lineage(window_stage_counts(tables.funnel, tables.rules, windows, days))
    if tables.driver_rows is not None:
        drivers = found_drivers(replace(tables, driver_rows=tables.driver_rows.where(days)), pairs, windows)
    if tables.metric_rows is not None:
        measured = cut_lineage(window_metrics(replace(tables, metric_rows=tables.metric_rows.where(days)), windows))
    supplied = tables.checks
    if tables.profiled:
        profile = cut_lineage(daily_profile(tables.profiled, days))
        computed = cut_lineage(window_checks(profile, pairs, list(tables.profiled)))
        # Supplied checks come after the computed ones.
        supplied = None if supplied is None else supplied.withColumn("position", F.lit(99))

    found = (stages, drivers, measured, computed, supplied)
    repeated = cut_lineage(known.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("alert_id"))
    single = known.join(repeated, "alert_id", "left_anti")
    of_pair = single.where((F.col("status") == "success") & F.col("alert_id").isNotNull())
    package = packages_by_pair(of_pair, pairs, *found)
    result = package.withColumns({"status": F.lit("success"), "candidates": F.lit(None).cast(known.schema["candidates"].dataType)})
    result = result.select("alert_id", "status", "candidates", *[c for c in package.columns if c != "alert_id"])
    heads = known.select("alert_id", "status", F.when(F.col("status") != "success", F.col("candidates")).alias("candidates"))
    bare = heads.join(repeated, "alert_id", "left_anti").where((F.col("status") != "success") | F.col("alert_id").isNull())
    result = result.unionByName(bare, allowMissingColumns=True)
    if not repeated.isEmpty():
        shared = packages_by_alert(good.join(repeated, "alert_id", "left_semi"), *found)
        result = result.unionByName(heads.join(repeated, "alert_id", "left_semi").join(shared, "alert_id", "left"))
    if not {"query", "queries"} & set(alerts.columns):
        return result
    results, _ = run_statements(stated_statements(alerts))
    item = F.struct("position", "name", "status", "row_count", "error")
    listed = results.groupBy("alert_id").agg(F.array_sort(F.collect_list(item)).alias("query_results"))
    return result.join(listed, "alert_id", "left")
