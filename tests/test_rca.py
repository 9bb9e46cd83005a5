from __future__ import annotations

import datetime as dt

import pytest
from conftest import plan
from pyspark.sql import functions as F

from funnelwright.operators import rca
from funnelwright.operators.daily import daily_metric, daily_metrics, with_delta
from funnelwright.operators.drivers import PACKAGE_KEYS, segment_changes
from funnelwright.operators.funnel import FunnelTables
from funnelwright.operators.quality import Profiled, daily_profile, window_checks
from funnelwright.plans import alert_rca
from funnelwright.plans.alert_daily import alert_requests, custom_results, daily_history, run_custom_sql
from funnelwright.plans.alert_rca import RcaTables, analyze_alerts, days_covered, driver_inputs, resolved_alerts, stated_statements
from funnelwright.sources.batch import run_statements
from funnelwright.sources.catalogs import METADATA_FIELDS

CONTEXT = {
    "alert_id": 1, "raw_user_query": "ZTQ204 left its range", "alert_date": dt.date(2031, 6, 18),
    "alert_type": "ratio_drop", "metric_view": "ratio", "parse_confidence": 0.85,
    "start_date": dt.date(2031, 6, 16), "end_date": dt.date(2031, 6, 18), "baseline_start_date": dt.date(2031, 5, 19),
    "baseline_end_date": dt.date(2031, 6, 15), "model_hint": "", "segment_hint": "", "market_hint": "", "analyst_notes": "",
}


def metadata_struct(**values):
    defaults = {f: F.lit("") for f in METADATA_FIELDS}
    defaults |= {"tags": F.array().cast("array<string>"), "aliases": F.array().cast("array<string>")}
    return F.struct(*[c.alias(n) for n, c in (defaults | {k: F.lit(v) for k, v in values.items()}).items()])


def alerts(spark, ids=(1,)):
    rows = [{**CONTEXT, "alert_id": i} for i in ids]
    meta = metadata_struct(
        variable_id="ZTQ204", variable_name="late_share", description="Late refunds in all refunds.",
        numerator_hint="late_refunds", denominator_hint="refunds",
    )
    return spark.createDataFrame(rows).withColumn("metadata", meta)


OBSERVED = "alert_id int, metric_value double, baseline_value double, numerator_value double, numerator_baseline double, denominator_value double, denominator_baseline double"
STAGES = "alert_id int, stage string, current double, baseline double"
CHECKS = "alert_id int, name string, status string, details string"


def test_all_findings_of_an_alert(spark):
    metrics = spark.createDataFrame([(1, 0.5, 0.8, 30.0, 40.0, 60.0, 50.0)], OBSERVED)
    stages = spark.createDataFrame([(1, "base", 200.0, 160.0), (1, "with_ff", 90.0, 120.0), (1, "notfrap", 66.0, 110.0), (1, "unheard", 1.0, 9.0)], STAGES)
    checks = spark.createDataFrame([(1, "late_files", "warn", "2 files")], CHECKS)
    package = rca.rca_package(alerts(spark), metrics, stages, None, checks)
    row = package.first()
    assert [s.stage for s in row.stage_diagnostics] == rca.REPORT_STAGES
    # Falls of 25 % and 40 %: only the deeper one is flagged.
    assert [s.stage for s in row.stage_diagnostics if s.flagged] == ["notfrap"]
    assert row.alert_summary.alert_direction == "down"
    assert row.alert_summary.pct_change == pytest.approx(-0.375)
    assert (row.metric_decomposition.numerator.label, row.metric_decomposition.denominator.label) == ("late_refunds", "refunds")
    assert [(h.confidence, h.evidence) for h in row.hypotheses] == [
        (0.78, ["Numerator pct_change=-25.00%"]),
        (0.76, ["Largest funnel drop at stage=notfrap"]),
        (0.72, ["Denominator pct_change=20.00%"]),
    ]
    assert [(c.name, c.status) for c in row.data_quality_checks] == [("late_files", "warn")]
    for part in ("ZTQ204 (late_share) on 2031-06-18", "ratio_drop", "Late refunds in all refunds.", "'notfrap'"):
        assert part in row.analyst_summary
    short = rca.compact(package).first()
    assert [s.stage for s in short.key_findings.flagged_stages] == ["notfrap"]
    assert short.metric_decomposition is not None and short.input_context.parse_confidence == 0.85


def test_defaults_without_observations(spark):
    package = rca.rca_package(alerts(spark))
    row = package.first()
    assert [c.status for c in row.data_quality_checks] == ["unknown"] * 3
    assert row.hypotheses[0].confidence == 0.55
    assert row.hypotheses[0].evidence == ["Alert type=ratio_drop", "Driver buckets present: "]
    assert len(row.stage_diagnostics) == 13 and not any(s.flagged for s in row.stage_diagnostics)
    assert "No stage-level outlier is confirmed yet." in row.analyst_summary
    assert rca.full(package).first().stage_diagnostics == []
    assert rca.compact(package).first().metric_decomposition is None


def test_thresholds_ties_and_checks(spark):
    metrics = spark.createDataFrame(
        [(1, 1.0, 0.0, 90.0, 100.0, 110.0, 100.0), (2, None, 1.0, 89.9, 100.0, 110.5, 100.0), (3, 1.0, None, None, None, None, None)], OBSERVED
    )
    stages = spark.createDataFrame(
        [(1, "base", 90.0, 100.0), (1, "with_zva", 90.0, 100.0), (2, "base", 90.1, 100.0), (3, "base", 5.0, 0.0), (3, "notff", None, 3.0)], STAGES
    )
    checks = spark.createDataFrame([(2, None, "FAIL", None), (2, "b", "fail", "x"), (3, "c", None, "d")], CHECKS)
    rows = {r.alert_id: r for r in rca.rca_package(alerts(spark, (1, 2, 3)), metrics, stages, None, checks).collect()}
    # -10 % exactly flags a stage (first of a tie) but is no numerator or denominator finding.
    assert [s.stage for s in rows[1].stage_diagnostics if s.flagged] == ["base"]
    assert [h.confidence for h in rows[1].hypotheses] == [0.76]
    assert rows[1].alert_summary.pct_change is None
    assert [h.confidence for h in rows[2].hypotheses] == [0.8, 0.78, 0.72]
    assert rows[2].hypotheses[0].evidence == ["Failed DQ checks: b, unnamed_check"]
    assert rows[3].hypotheses[0].confidence == 0.55 and rows[3].data_quality_checks[0].status == "pass"
    top = {r.alert_id: r for r in rca.compact(rca.rca_package(alerts(spark, (1, 2, 3)), metrics, stages, None, checks)).collect()}
    assert len(top[2].key_findings.top_hypotheses) == 3


def test_daily_delta(spark):
    rows = [(dt.date(2024, 1, d), float(v)) for d, v in [(1, 2), (1, 4), (2, 9), (4, 1)]] + [(dt.date(2024, 1, 4), None)]
    df = spark.createDataFrame(rows, "trans_dt date, m double")
    got = [tuple(r)[1:] for r in with_delta(daily_metric(df, "trans_dt", "m")).orderBy("trans_dt").collect()]
    assert got == [(2, 3.0, None), (1, 9.0, 6.0), (2, 1.0, -8.0)]
    many = {(r.trans_dt.day, r.metric): (r.txn_cnt, r.value_cnt, r.avg_metric) for r in daily_metrics(df, "trans_dt", {"m": F.col("m"), "n": F.lit(None)}).collect()}
    assert many[4, "m"] == (2, 1, 1.0) and many[4, "n"] == (2, 0, None)


def sheet(spark):
    rows = [("ZTQ204", "amt_ratio", "tbl", "urgent", "amount"), ("KLP7012", "cnt", "tbl", "", ""), ("KLP7013", "cnt", "tbl2", "", "")]
    df = spark.createDataFrame(rows, "id string, name string, src string, num string, den string")
    blank = F.lit("")
    values = {
        "variable_id": F.col("id"), "variable_name": F.col("name"), "source_table": F.col("src"),
        "numerator_hint": F.col("num"), "denominator_hint": F.col("den"),
        "tags": F.array().cast("array<string>"), "aliases": F.array().cast("array<string>"),
    }
    return df.select(*[values.get(f, blank).alias(f) for f in METADATA_FIELDS], F.monotonically_increasing_id().alias("file_order"))


def test_alert_daily(spark):
    requests = spark.createDataFrame(
        [
            (1, "ZTQ204 dropped on 2024-01-03", None, None, None, dt.date(2024, 1, 1)),
            (2, "look at cnt please", "cnt", None, None, None),
            (3, "what happened", None, None, None, None),
            (4, "x", "KLP7012", None, "SELECT 1", None),
            (5, "new thing on 2024-01-02", "NEW_V", "tbl", None, None),
        ],
        "alert_id int, user_query string, variable_id string, alert_table string, sql_query string, start_date date",
    )
    resolved = alert_requests(requests, sheet(spark), "2024-01-02")
    got = {r.alert_id: r for r in resolved.collect()}
    assert (got[1].status, got[1].metric, got[1].table_name) == ("success", "amt_ratio", "tbl")
    assert (got[1].start_date, got[1].end_date) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    assert got[3].status == "needs_user_input"
    assert got[4].sql_source == "llm_query" and got[1].sql_source == "fallback_template"
    assert (got[5].status, got[5].resolved_id, got[5].metric) == ("success", "NEW_V", "NEW_V")
    rows = [(dt.date(2024, 1, d), float(d), 1.0) for d in (1, 2, 2, 3, 4)]
    tables = {"tbl": spark.createDataFrame(rows, "trans_dt date, amt_ratio double, cnt double")}
    history = daily_history(resolved, tables, {"tbl": ["amt_ratio", "cnt"]}).orderBy("alert_id", "trans_dt").collect()
    assert [(r.alert_id, r.trans_dt.day, r.txn_cnt, r.avg_metric, r.metric_delta) for r in history if r.trans_dt and r.alert_id == 1] == [
        (1, 1, 1, 1.0, None), (1, 2, 2, 2.0, 1.0), (1, 3, 1, 3.0, 1.0),
    ]
    # Every request has a row; without days it says why.
    assert {r.alert_id for r in history} == {1, 2, 3, 4, 5}
    assert {r.alert_id: r.status for r in history if r.trans_dt is None} == {2: "needs_user_input", 3: "needs_user_input", 4: "custom_sql", 5: "unknown_metric"}
    runs = run_custom_sql(spark, {"4": "SELECT 1 AS one", "9": "SELECT nope"})
    assert [(r.name, r.status, r.row_count) for r in runs] == [("alert_rationalization_4", "success", 1), ("alert_rationalization_9", "error", 0)]


def test_custom_statements_are_joined_to_their_alerts(spark):
    spark.range(3).createOrReplaceTempView("three")
    asked = spark.createDataFrame(
        [(1, "ZTQ204", "SELECT id, id AS ID, null AS none FROM three"), (2, "ZTQ204", "SELECT id, id AS ID, null AS none FROM three"),
         (3, "ZTQ204", "SELECT nope"), (4, "ZTQ204", "SELECT id FROM three WHERE id > 5"), (5, "ZTQ204", None)],
        "alert_id int, variable_id string, sql_query string",
    )
    got = custom_results(alert_requests(asked, sheet(spark), "2024-01-02")).collect()
    by_alert = {i: sorted((r.status, r.row_count, r.row) for r in got if r.alert_id == i) for i in range(1, 6)}
    assert by_alert[1] == by_alert[2] == [("success", 3, f'{{"id":{i},"ID_2":{i}}}') for i in range(3)]
    assert by_alert[3] == [("error", 0, None)] and by_alert[4] == [("success", 0, None)] and by_alert[5] == []


def test_findings_have_the_callers_statements(spark):
    spark.range(3).createOrReplaceTempView("three")
    asked = spark.createDataFrame(
        [(1, "ZTQ204 drop", "SELECT count(*) AS n FROM three", [("", "SELECT 1 AS one"), ("x", " "), ("bad", "SELECT nope")]), (2, "ZTQ204 drop", None, None)],
        "alert_id int, user_query string, query string, queries array<struct<name:string,sql:string>>",
    )
    got = {r.alert_id: r.query_results for r in analyze_alerts(asked, sheet(spark), RcaTables(), "2024-02-02").collect()}
    assert [(q.name, q.status, q.row_count) for q in got[1]] == [("adhoc_query", "success", 1), ("query_1", "success", 1), ("bad", "error", 0)]
    assert got[2] is None
    _, rows = run_statements(stated_statements(asked))
    assert sorted((r.alert_id, r.name, r.row) for r in rows.collect()) == [(1, "adhoc_query", '{"n":3}'), (1, "query_1", '{"one":1}')]


def test_ambiguous_alert_stops(spark):
    rows = sheet(spark)
    requests = spark.createDataFrame([(1, "ZTQ204 drop"), (2, "for cnt"), (3, "for nothing_known")], "alert_id int, user_query string")
    got = {r.alert_id: r for r in analyze_alerts(requests, rows, RcaTables(), "2024-02-02").collect()}
    assert {i: r.status for i, r in got.items()} == {1: "success", 2: "needs_user_input", 3: "not_found"}
    assert [c.variable_id for c in got[2].candidates] == ["KLP7012", "KLP7013"] and got[2].hypotheses is None
    assert got[1].candidates is None and got[1].hypotheses[0].confidence == 0.55
    daily = {r.alert_id: r for r in alert_requests(requests, rows, "2024-02-02").collect()}
    assert daily[2].status == "needs_user_input" and len(daily[2].candidates) == 2
    assert daily[3].status == "success" and daily[3].metric == "nothing_known"


def test_a_stated_variable_wins_over_the_text(spark):
    requests = spark.createDataFrame(
        [(1, "on 2024-01-03 the variable KLP7012 saw a drop", "ZTQ204"), (2, "variable ZTQ204 dropped", " ")],
        "alert_id int, user_query string, variable_id string",
    )
    got = {r.alert_id: r for r in resolved_alerts(requests, sheet(spark), "2024-02-02").collect()}
    assert {i: r.metadata.variable_id for i, r in got.items()} == {1: "ZTQ204", 2: "ZTQ204"}
    daily = {r.alert_id: r.resolved_id for r in alert_requests(requests, sheet(spark), "2024-02-02").collect()}
    assert daily == {1: "ZTQ204", 2: "ZTQ204"}


def test_no_matching_group_for_empty_alerts(spark):
    empty = spark.createDataFrame([], "alert_id int, user_query string")
    assert analyze_alerts(empty, sheet(spark), RcaTables(), "2024-02-02").collect() == []


def test_changes_between_windows(spark):
    counts = spark.createDataFrame(
        [("w1", "mcc", "a", 30), ("w1", "mcc", "b", 6), ("w1", "mcc", None, 3), ("w0", "mcc", "a", 280), ("w0", "mcc", "c", 56), ("w1", "country", "x", 39), ("w2", "mcc", "a", 9)],
        "window_id string, dimension string, segment_value string, cnt long",
    )
    pairs = spark.createDataFrame([("p", "current", "w1", 3), ("p", "baseline", "w0", 28), ("q", "current", "w2", 1), ("q", "baseline", "none", 5)], "pair_id string, role string, window_id string, days int")
    got = {(r.pair_id, r.dimension, r.segment_value): r for r in segment_changes(counts, pairs, 3).collect()}
    # A day: a 10 and 10, b 2 and 0, null 1 and 0, c 0 and 2; in all 13 and 12.
    assert {k[2]: (r.segment_rank, r.current, r.baseline, r.change) for k, r in got.items() if k[:2] == ("p", "mcc")} == {
        "b": (1, 2.0, 0.0, 2.0), "c": (2, 0.0, 2.0, -2.0), None: (3, 1.0, 0.0, 1.0),
    }
    assert got["p", "mcc", "c"].size_effect == pytest.approx(2 / 12) and got["p", "mcc", "c"].mix_effect == pytest.approx(-2 - 2 / 12)
    assert (got["q", "mcc", "a"].change, got["q", "mcc", "a"].mix_effect, got["p", "country", "x"].baseline) == (9.0, 9.0, 0.0)
    everything = segment_changes(counts, pairs).where("pair_id = 'p' and dimension = 'mcc'").agg(F.sum("change"), F.sum("size_effect"), F.sum("mix_effect")).first()
    assert list(everything) == [pytest.approx(1.0), pytest.approx(1.0), pytest.approx(0.0)]


def test_computed_checks(spark):
    day = lambda d: dt.date(2031, 6, d)
    rows = [(day(d), "k") for d in range(1, 10) for _ in range(4)] + [(day(9), None), (day(10), "k"), (day(10), "k")]
    good = spark.createDataFrame(rows, "trans_dt date, key string")
    late = spark.createDataFrame([(day(d), "k", day(d + 3)) for d in range(1, 11)], "seen date, key string, came date")
    tables = {"good": Profiled(good, ["key"]), "late": Profiled(late, ["key"], "seen", "came")}
    pairs = spark.createDataFrame(
        [("p", day(7), day(8), day(1), day(6)), ("q", day(9), day(10), day(1), day(8)), ("r", day(20), day(21), day(11), day(19)), ("s", day(10), day(11), day(1), day(2))],
        "pair_id string, start_date date, end_date date, baseline_start_date date, baseline_end_date date",
    )

    def found(names):
        profile = daily_profile({n: tables[n] for n in names})
        return {(r.pair_id, r.name): (r.status, r.details) for r in window_checks(profile, pairs, names).collect()}

    got = found(["good"])
    assert got["p", "missing_key_fields"] == ("pass", "good: 0 of 8 rows")
    assert got["q", "missing_key_fields"] == ("fail", "good: 1 of 7 rows")
    assert got["p", "row_count_gap"] == ("pass", "good: 8 rows on 2 of 2 days, before 24 on 6 of 6")
    assert got["s", "row_count_gap"] == ("fail", "good: 2 rows on 1 of 2 days, before 8 on 2 of 2")
    assert got["q", "row_count_gap"][0] == "pass" and got["q", "ingestion_lag"] == ("pass", "good: 0 days")
    assert got["s", "ingestion_lag"] == ("fail", "good: 1 days")
    assert {got["r", n][0] for n in ("missing_key_fields", "row_count_gap", "ingestion_lag")} == {"unknown"}
    both = found(["good", "late"])
    assert both["p", "ingestion_lag"] == ("fail", "good: 0 days; late: 3 days")
    assert both["p", "missing_key_fields"] == ("pass", "good: 0 of 8 rows; late: 0 of 2 rows")


def test_far_alerts_prune_the_days_between(spark, tmp_path):
    day = lambda m, d: dt.date(2031, m, d)
    rows = spark.createDataFrame([(day(m, d), m * d) for m in range(1, 13) for d in range(1, 29)], "trans_dt date, v int")
    rows.write.partitionBy("trans_dt").parquet(str(tmp_path / "facts"))
    windows = spark.createDataFrame([("a", day(2, 3), day(2, 5)), ("b", day(2, 5), day(2, 8)), ("c", day(11, 20), day(11, 21))], "window_id string, start_date date, end_date date")
    facts = spark.read.parquet(str(tmp_path / "facts"))
    kept = facts.where(days_covered(windows))
    assert sorted(r.trans_dt for r in kept.collect()) == [day(2, d) for d in range(3, 9)] + [day(11, 20), day(11, 21)]
    scan = next(line for line in plan(kept).splitlines() if "PartitionFilters" in line)
    assert "<= 2031-02-08" in scan and " OR " in scan
    assert len(kept.inputFiles()) <= 336 and facts.where(days_covered(windows.limit(0))).count() == 0


def test_many_ranges_are_joined(spark, monkeypatch):
    monkeypatch.setattr(alert_rca, "MOST_RANGES", 2)
    day = lambda d: dt.date(2031, 1, d)
    windows = spark.createDataFrame([(day(1), day(2)), (day(5), day(5)), (day(20), day(21)), (day(31), day(31))], "start_date date, end_date date")
    days = spark.range(1, 32).select(F.date_add(F.lit("2030-12-31").cast("date"), F.col("id").cast("int")).alias("trans_dt"))
    kept = sorted(r.trans_dt.day for r in days.where(alert_rca.days_covered(windows)).collect())
    assert kept == [1, 2, 3, 4, 5, *range(20, 32)]


def test_findings_compare_both_windows(spark):
    day = lambda d: dt.date(2031, 3, d)
    auth = spark.createDataFrame(
        [(i, i % 3, i % 3, "0", day(1 + i % 30), 10.0, "false", "1", "food" if i % 30 < 27 else "fuel", "DE") for i in range(90)],
        "cas_pkey int, cm15 int, cm13 int, appr_deny_cd string, trans_dt date, amount double, cancl_plastic_cd string, arm_proc_ind string, cm11 string, country_cd string",
    )
    labels = auth.where("cas_pkey % 2 = 0").select("cas_pkey", "trans_dt", F.lit(1).alias("lift_frd_in"), F.lit("m1").alias("modl_id"), F.lit("p1").alias("lift_path_ds"))
    flags = auth.select("cas_pkey", "trans_dt", F.lit("0").alias("zero_value_auth_ind"))
    rows, dimensions = driver_inputs(FunnelTables(auth, labels, flags, auth, auth, auth))
    assert set(dimensions) == set(PACKAGE_KEYS) and rows.count() == 90
    tables = RcaTables(driver_rows=rows, dimensions=dimensions, amount=F.col("amount"), profiled={"auth": Profiled(auth, ["cas_pkey"])})
    asked = spark.createDataFrame([(1, "ZTQ204 dropped on 2031-03-30"), (2, "ZTQ204 dropped on 2031-03-30")], "alert_id int, user_query string")
    got = analyze_alerts(asked, sheet(spark), tables, "2031-04-01").collect()
    assert len(got) == 2
    row = got[0]
    assert [(s.segment_value, s.cnt) for s in row.top_drivers.mcc] == [("fuel", 9)]
    assert [(s.segment_value, s.cnt) for s in row.baseline_drivers.mcc] == [("food", 81)]
    # 27 days with rows of the 28: food 81 / 28 a day before, fuel 3 a day now.
    assert [(s.segment_value, round(s.change, 6)) for s in row.driver_changes.mcc] == [("fuel", 3.0), ("food", round(-81 / 28, 6))]
    assert all(len(row.top_drivers[k]) for k in PACKAGE_KEYS) and {s.segment_value for s in row.top_drivers.model_id} == {"m1", None}
    assert [c.status for c in row.data_quality_checks] == ["pass", "pass", "pass"]


def test_alerts_are_dealt_out_before_they_are_parsed(spark):
    alerts = spark.range(0, 100, 1, 1).selectExpr("id as alert_id", "concat('variable item_', id, ' saw a drop') as user_query")
    parsed = alert_rca.parsed_requests(alerts, "2024-01-10")
    assert "REPARTITION_BY_COL" in plan(parsed)
    assert parsed.count() == 100


def of_days(spark):
    """Rows of an authorization table over thirty days of March 2031, with labels and flags for its drivers."""
    auth = spark.createDataFrame(
        [(i, i % 3, i % 3, "0", dt.date(2031, 3, 1 + i % 30), 10.0, "false", "1", "food" if i % 30 < 27 else "fuel", "DE") for i in range(90)],
        "cas_pkey int, cm15 int, cm13 int, appr_deny_cd string, trans_dt date, amount double, cancl_plastic_cd string, arm_proc_ind string, cm11 string, country_cd string",
    )
    labels = auth.where("cas_pkey % 2 = 0").select("cas_pkey", "trans_dt", F.lit(1).alias("lift_frd_in"), F.lit("m1").alias("modl_id"), F.lit("p1").alias("lift_path_ds"))
    flags = auth.select("cas_pkey", "trans_dt", F.lit("0").alias("zero_value_auth_ind"))
    rows, dimensions = driver_inputs(FunnelTables(auth, labels, flags, auth, auth, auth))
    return {
        "driver_rows": rows, "dimensions": dimensions, "amount": F.col("amount"), "profiled": {"auth": Profiled(auth, ["cas_pkey"])},
        "metric_rows": auth, "metrics": {"ZTQ204": F.col("amount"), "late_refunds": F.col("amount") * 2},
    }


def test_findings_are_put_together_per_pair_of_windows(spark):
    tables = of_days(spark)
    asked = [(1, "ZTQ204 dropped on 2031-03-30"), (2, "ZTQ204 dropped on 2031-03-30"), (3, "ZTQ204 dropped on 2031-03-28"), (4, "no idea"), (None, "ZTQ204 dropped on 2031-03-28")]
    frame = spark.createDataFrame(asked, "alert_id int, user_query string")
    supplied = spark.createDataFrame([(2, "late_files", "warn", "2 files"), (2, "early_files", None, None)], CHECKS)
    found = analyze_alerts(frame, sheet(spark), RcaTables(**tables, checks=supplied), "2031-04-01")
    got = {r.alert_id: r for r in found.collect()}
    # The way by alert_id gives the same for every alert; a spare row of one id makes it take that way.
    twice = spark.createDataFrame([*asked, *asked], "alert_id int, user_query string")
    shared = {r.alert_id: r for r in analyze_alerts(twice, sheet(spark), RcaTables(**tables), "2031-04-01").collect()}
    for i in (1, 3):
        alone, other = got[i].asDict(True), shared[i].asDict(True)
        assert [c["name"] for c in alone.pop("data_quality_checks")] == [c["name"] for c in other.pop("data_quality_checks")][::2]
        assert alone == other and alone["top_drivers"]["mcc"] and alone["alert_summary"]["metric_value"] == 10.0
    assert [c.name for c in got[2].data_quality_checks] == ["missing_key_fields", "row_count_gap", "ingestion_lag", "early_files", "late_files"]
    assert (got[4].status, got[4].input_context) == ("not_found", None)
    assert (got[None].status, got[None].input_context, got[None].driver_changes) == ("success", None, None)
    # No package is carried by alert: alerts meet the findings of their pair, and by id only the ids that repeat.
    joins = [line for line in plan(analyze_alerts(frame, sheet(spark), RcaTables(**tables), "2031-04-01")).splitlines() if "Join [" in line]
    assert {("LeftAnti" if "alert_id" in line else "pair_id" in line) for line in joins} == {"LeftAnti", True}


def test_alerts_of_one_id_share_their_findings(spark):
    tables = RcaTables(profiled=of_days(spark)["profiled"])
    asked = [(1, "ZTQ204 dropped on 2031-03-30"), (1, "ZTQ204 dropped on 2031-03-28"), (2, "ZTQ204 dropped on 2031-03-30")]
    found = analyze_alerts(spark.createDataFrame(asked, "alert_id int, user_query string"), sheet(spark), tables, "2031-04-01")
    got = found.select("alert_id", F.size("data_quality_checks").alias("checks"), "analysis_window.end_date").collect()
    assert sorted((r.alert_id, r.checks, r.end_date.day) for r in got) == [(1, 6, 28), (1, 6, 28), (1, 6, 30), (1, 6, 30), (2, 3, 30)]


def test_segments_are_summed_where_their_days_lie(spark, monkeypatch):
    monkeypatch.setattr(alert_rca, "ROWS_A_PART", 20)
    day = lambda d: dt.date(2031, 3, d)
    rows = [(day(d), "mcc", s, d, float(d)) for d in range(1, 21) for s in ("a", "b", None)]
    daily = spark.createDataFrame(rows, "trans_dt date, dimension string, segment_value string, cnt long, total_amt double")
    days = spark.createDataFrame([(w, day(d)) for w in range(1, 19) for d in range(w, w + 3)], "window_id long, trans_dt date").localCheckpoint()
    segments = alert_rca.window_segments(daily, F.broadcast(days))
    counts = segments.groupBy("window_id", "dimension", "segment_value").agg(F.sum("cnt").alias("cnt"))
    text = plan(counts)
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(dimension" in text
    assert {(r.window_id, r.segment_value): r.cnt for r in counts.collect()} == {(w, s): 3 * w + 3 for w in range(1, 19) for s in ("a", "b", None)}
    packages = {r.window_id: r.top_drivers for r in alert_rca.window_drivers(segments).collect()}
    assert [(s.segment_rank, s.segment_value, s.cnt, s.total_amt) for s in packages[4].mcc] == [(1, None, 15, 15.0), (2, "a", 15, 15.0), (3, "b", 15, 15.0)]
