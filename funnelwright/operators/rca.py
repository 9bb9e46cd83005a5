"""Root-cause findings per alert from typed observation tables.

Every table is keyed by ``alert_id``; one job covers any number of alerts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.functions.measures import pct_change, percent_text
from funnelwright.operators.drivers import PACKAGE_KEYS
from funnelwright.operators.funnel import STAGES

# Stages reported per alert (the last three come only from supplied counts),
# alert directions, thresholds, default checks, hypothesis texts with their confidence.
REPORT_STAGES = [*STAGES, "no_roc_v1", "no_roc_v2", "final_output"]
DOWN_TYPES = ["lower_limit_breach", "ratio_drop"]
UP_TYPES = ["upper_limit_breach", "ratio_spike", "count_alert"]
CHANGE_LIMIT = 0.1
DEFAULT_CHECKS = [
    ("missing_key_fields", "unknown", "No missing-value profile provided."),
    ("row_count_gap", "unknown", "No row count profile provided."),
    ("ingestion_lag", "unknown", "No ingestion timestamps provided."),
]
HYPOTHESES = {
    "data_quality": ("Data quality or ingestion issue likely contributed to the alert.", 0.80),
    "numerator": ("Numerator decline is driving the alert.", 0.78),
    "stage": ("Stage-specific filter or routing change introduced volume loss.", 0.76),
    "denominator": ("Denominator inflation reduced the ratio.", 0.72),
    "mix_shift": ("Potential mix-shift in segment or model routing.", 0.55),
}
NO_DEFINITION = "Definition unavailable in metadata."
NO_STAGE = "No stage-level outlier is confirmed yet."
NEXT_CHECKS = (
    "Next checks: run stage_funnel_sql for alert and baseline windows, validate top driver buckets, "
    "and confirm ingestion completeness."
)
TOP_HYPOTHESES = 3

OBSERVED = [
    "metric_value", "baseline_value", "numerator_value", "numerator_baseline", "denominator_value",
    "denominator_baseline",
]
_STAGE_TYPE = "array<struct<stage:string,current_count:double,baseline_count:double,pct_change:double,flagged:boolean>>"
CHECKS_TYPE = "array<struct<name:string,status:string,details:string>>"


def alert_summary(alert_type: Column, metric: Column, baseline: Column) -> Column:
    direction = F.when(alert_type.isin(*DOWN_TYPES), "down").when(alert_type.isin(*UP_TYPES), "up").otherwise("unknown")
    return F.struct(
        metric.alias("metric_value"),
        baseline.alias("baseline_value"),
        pct_change(metric, baseline).alias("pct_change"),
        direction.alias("alert_direction"),
    )


def metric_part(label: Column, default: str, value: Column, baseline: Column) -> Column:
    name = F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(default)
    return F.struct(
        name.alias("label"),
        value.alias("value"),
        baseline.alias("baseline"),
        pct_change(value, baseline).alias("pct_change"),
    )


def stage_diagnostics(stage_counts: DataFrame) -> DataFrame:
    """One array of all report stages per alert; the lowest change is flagged if it is -10 % or less.

    ``stage_counts``: alert_id, stage, current, baseline. Of equally low stages the first is
    flagged; a stage without counts stays in the list with nulls.
    """
    known = stage_counts.where(F.col("stage").isin(*REPORT_STAGES))
    one = known.groupBy("alert_id", "stage").agg(
        F.max(F.col("current").try_cast("double")).alias("current"),
        F.max(F.col("baseline").try_cast("double")).alias("baseline"),
    )
    entry = F.struct("stage", F.struct("current", "baseline").alias("counts"))
    by_alert = one.groupBy("alert_id").agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))
    return by_alert.select("alert_id", diagnostics_column(F.col("counts")).alias("stage_diagnostics"))


def diagnostics_column(counts: Column) -> Column:
    """Array of stage structs from a map stage -> (current, baseline)."""
    rows = F.transform(
        F.array(*map(F.lit, REPORT_STAGES)),
        lambda stage: F.struct(stage.alias("stage"), F.try_element_at(counts, stage).alias("c")),
    )
    changed = F.transform(
        rows,
        lambda r: F.struct(
            r["stage"].alias("stage"),
            r["c"]["current"].alias("current_count"),
            r["c"]["baseline"].alias("baseline_count"),
            pct_change(r["c"]["current"], r["c"]["baseline"]).alias("pct_change"),
        ),
    )

    def flag(all_rows: Column) -> Column:
        drops = F.filter(
            F.transform(all_rows, lambda r, i: F.struct(r["pct_change"].alias("pct"), i.alias("i"))),
            lambda r: r["pct"] < 0,
        )
        return F.transform(
            F.array(F.struct(all_rows.alias("rows"), F.array_min(drops).alias("low"))),
            lambda s: F.transform(
                s["rows"],
                lambda r, i: F.struct(
                    r["stage"].alias("stage"),
                    r["current_count"].alias("current_count"),
                    r["baseline_count"].alias("baseline_count"),
                    r["pct_change"].alias("pct_change"),
                    F.coalesce((s["low"]["i"] == i) & (s["low"]["pct"] <= -CHANGE_LIMIT), F.lit(False)).alias("flagged"),
                ),
            ),
        )

    return F.element_at(F.element_at(F.transform(F.array(changed), flag), 1), 1).cast(_STAGE_TYPE)


def empty_diagnostics() -> Column:
    no_counts = F.create_map().cast("map<string,struct<current:double,baseline:double>>")
    return diagnostics_column(no_counts)


def default_checks() -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(s).alias("status"), F.lit(d).alias("details"))
            for n, s, d in DEFAULT_CHECKS
        ]
    )


def check_records(checks: DataFrame) -> DataFrame:
    """Checks per alert with defaults filled in; ordered by ``position`` if there is one, else by name."""
    record = F.struct(
        F.coalesce("name", F.lit("unnamed_check")).alias("name"),
        F.coalesce("status", F.lit("pass")).alias("status"),
        F.coalesce("details", F.lit("")).alias("details"),
    )
    position = F.col("position") if "position" in checks.columns else F.lit(0)
    ordered = F.array_sort(F.collect_list(F.struct(position.alias("position"), record.alias("record"))))
    return (
        checks.groupBy("alert_id")
        .agg(ordered.alias("ordered"))
        .select("alert_id", F.transform("ordered", lambda o: o["record"]).alias("data_quality_checks"))
    )


def hypotheses_column(
    alert_type: Column, decomposition: Column, diagnostics: Column, checks: Column, drivers: Column
) -> Column:
    """Hypotheses that apply, by falling confidence; a mix-shift one if none does."""

    def item(name: str, *evidence: Column) -> Column:
        text, confidence = HYPOTHESES[name]
        return F.struct(
            F.lit(text).alias("hypothesis"), F.lit(confidence).alias("confidence"), F.array(*evidence).alias("evidence")
        )

    num, den = decomposition["numerator"]["pct_change"], decomposition["denominator"]["pct_change"]
    flagged = F.filter(diagnostics, lambda s: s["flagged"])
    failed = F.filter(checks, lambda c: F.lower(c["status"]) == "fail")
    names = F.array_join(F.transform(failed, lambda c: c["name"]), ", ")
    present = F.array_join(
        F.filter(F.array(*[F.when(F.size(drivers[k]) > 0, F.lit(k)) for k in PACKAGE_KEYS]), lambda k: k.isNotNull()), ", "
    )
    # In order of falling confidence.
    found = F.array(
        F.when(F.size(failed) > 0, item("data_quality", F.concat(F.lit("Failed DQ checks: "), names))),
        F.when(num < -CHANGE_LIMIT, item("numerator", F.concat(F.lit("Numerator pct_change="), percent_text(num)))),
        F.when(
            F.size(flagged) > 0,
            item("stage", F.concat(F.lit("Largest funnel drop at stage="), F.get(flagged, F.lit(0))["stage"])),
        ),
        F.when(den > CHANGE_LIMIT, item("denominator", F.concat(F.lit("Denominator pct_change="), percent_text(den)))),
    )
    fallback = item(
        "mix_shift", F.concat(F.lit("Alert type="), alert_type), F.concat(F.lit("Driver buckets present: "), present)
    )
    kept = F.filter(found, lambda h: h.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(fallback))


def analyst_summary(df_context: Column, description: Column, diagnostics: Column, hypotheses: Column) -> Column:
    stage = F.get(F.filter(diagnostics, lambda s: s["flagged"]), F.lit(0))["stage"]
    stage_text = F.coalesce(
        F.concat(F.lit("Largest funnel movement appears at stage '"), stage, F.lit("'.")), F.lit(NO_STAGE)
    )
    definition = F.when(F.coalesce(description, F.lit("")) != "", description).otherwise(NO_DEFINITION)
    c = df_context
    return F.concat(
        F.lit("Initial RCA for "), c["resolved_variable_id"], F.lit(" ("), c["resolved_variable_name"], F.lit(") on "),
        c["alert_date"].cast("string"), F.lit(" classified as "), c["alert_type"], F.lit(". "), definition, F.lit(" "),
        stage_text, F.lit(" Top likely cause: "), F.get(hypotheses, F.lit(0))["hypothesis"], F.lit(f" {NEXT_CHECKS}"),
    )


CONTEXT_FIELDS = [
    "raw_user_query", "resolved_variable_id", "resolved_variable_name", "alert_date", "alert_type", "metric_view",
    "parse_confidence", "start_date", "end_date", "baseline_start_date", "baseline_end_date", "model_hint",
    "segment_hint", "market_hint", "analyst_notes",
]


def empty_drivers() -> Column:
    item = "array<struct<segment_rank:int,segment_value:string,cnt:bigint,total_amt:double>>"
    return F.struct(*[F.array().cast(item).alias(k) for k in PACKAGE_KEYS])


def rca_package(
    alerts: DataFrame,
    metrics: DataFrame | None = None,
    stage_counts: DataFrame | None = None,
    drivers: DataFrame | None = None,
    checks: DataFrame | None = None,
) -> DataFrame:
    """One row per resolved alert with all findings.

    alerts: alert_id, parsed alert fields, the four window dates, ``metadata`` (struct).
    metrics: alert_id and the six observed values. stage_counts: alert_id, stage, current,
    baseline. drivers: alert_id, top_drivers (struct). checks: alert_id, name, status,
    details. Missing tables and missing alerts in a table give the defaults.
    """
    df = alerts
    if metrics is not None:
        df = df.join(metrics.select("alert_id", *[F.col(c).try_cast("double").alias(c) for c in OBSERVED]), "alert_id", "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in OBSERVED})
    for table, column, default in (
        (None if stage_counts is None else stage_diagnostics(stage_counts), "stage_diagnostics", empty_diagnostics()),
        (drivers, "top_drivers", empty_drivers()),
        (None if checks is None else check_records(checks), "data_quality_checks", default_checks()),
    ):
        if table is None:
            df = df.withColumn(column, default)
        else:
            df = df.join(table.select("alert_id", column), "alert_id", "left")
            df = df.withColumn(column, F.coalesce(F.col(column), default))
    return packaged(df)


def packaged(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The findings of resolved alerts whose observed values, stages, drivers and checks stand beside them.

    ``more`` names columns that stay as they are, after the findings.
    """
    meta = F.col("metadata")
    df = df.withColumns(
        {
            "resolved_variable_id": meta["variable_id"],
            "resolved_variable_name": F.when(meta["variable_name"] != "", meta["variable_name"]).otherwise(
                meta["variable_id"]
            ),
        }
    )
    df = df.withColumns(
        {
            "input_context": F.struct(*CONTEXT_FIELDS),
            "alert_summary": alert_summary(F.col("alert_type"), F.col("metric_value"), F.col("baseline_value")),
            "metric_decomposition": F.struct(
                metric_part(
                    meta["numerator_hint"], "numerator", F.col("numerator_value"), F.col("numerator_baseline")
                ).alias("numerator"),
                metric_part(
                    meta["denominator_hint"], "denominator", F.col("denominator_value"), F.col("denominator_baseline")
                ).alias("denominator"),
            ),
        }
    )
    df = df.withColumn(
        "hypotheses",
        hypotheses_column(
            F.col("alert_type"),
            F.col("metric_decomposition"),
            F.col("stage_diagnostics"),
            F.col("data_quality_checks"),
            F.col("top_drivers"),
        ),
    )
    summary = analyst_summary(
        F.col("input_context"), meta["description"], F.col("stage_diagnostics"), F.col("hypotheses")
    )
    return df.select(
        "alert_id",
        "input_context",
        meta.alias("resolved_variable_metadata"),
        F.struct("start_date", "end_date").alias("analysis_window"),
        F.struct(
            F.col("baseline_start_date").alias("start_date"), F.col("baseline_end_date").alias("end_date")
        ).alias("baseline_window"),
        "alert_summary",
        "metric_decomposition",
        "stage_diagnostics",
        "top_drivers",
        "data_quality_checks",
        "hypotheses",
        summary.alias("analyst_summary"),
        *more,
    )


COMPACT_CONTEXT = CONTEXT_FIELDS[:7]
COMPACT_METADATA = ["variable_id", "variable_name", "description", "source_table", "segment", "model_family"]


def compact(package: DataFrame) -> DataFrame:
    """Flagged stages, top three hypotheses, short context and metadata; empty decomposition as null."""
    d = F.col("metric_decomposition")
    any_value = F.coalesce(*[d[side][f] for side in ("numerator", "denominator") for f in ("value", "baseline", "pct_change")])
    top = F.transform(
        F.slice("hypotheses", 1, TOP_HYPOTHESES),
        lambda h: F.struct(h["hypothesis"].alias("hypothesis"), h["confidence"].alias("confidence")),
    )
    return package.select(
        "alert_id",
        F.struct(*[F.col("input_context")[f].alias(f) for f in COMPACT_CONTEXT]).alias("input_context"),
        F.struct(*[F.col("resolved_variable_metadata")[f].alias(f) for f in COMPACT_METADATA]).alias(
            "resolved_variable_metadata"
        ),
        "analysis_window",
        "baseline_window",
        "alert_summary",
        F.struct(
            F.filter("stage_diagnostics", lambda s: s["flagged"]).alias("flagged_stages"), top.alias("top_hypotheses")
        ).alias("key_findings"),
        "analyst_summary",
        F.when(any_value.isNotNull(), d).alias("metric_decomposition"),
    )


def full(package: DataFrame) -> DataFrame:
    """The package with an empty stage list where no stage has any value."""
    seen = F.exists(
        "stage_diagnostics",
        lambda s: s["current_count"].isNotNull() | s["baseline_count"].isNotNull() | s["pct_change"].isNotNull(),
    )
    return package.withColumn(
        "stage_diagnostics", F.when(seen, F.col("stage_diagnostics")).otherwise(F.array().cast(_STAGE_TYPE))
    )
