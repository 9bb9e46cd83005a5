"""The library's operators applied to the test tables.

Stand-ins: ``orders`` are the authorizations, ``lineitem`` rolled up per order gives labels,
flags and referral codes, ``customer`` the analytics, ``events`` the transaction histories,
``part`` the feature catalog, ``conversations`` the chat log.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelwright.functions.measures import age_in_days, derive_windows, in_dates, safe_double
from funnelwright.functions.text import parse_alerts, parse_structured_alerts
from funnelwright.operators import catalog as lookups
from funnelwright.operators import chatlog, rca
from funnelwright.operators.daily import daily_metric, with_delta
from funnelwright.operators.drivers import PACKAGE_KEYS, driver_package, segment_counts, top_per_dimension, top_segments
from funnelwright.operators.funnel import (
    FunnelRules,
    FunnelTables,
    count_frames,
    stage_counts,
    stage_frames,
)
from funnelwright.operators.history import Exclusion, history_map
from funnelwright.operators.quality import Profiled, daily_profile, window_checks
from funnelwright.operators.sampling import join_labels, key_uniform, label_preserving_sample
from funnelwright.operators.sequences import (
    SequenceSpec,
    bucketize,
    expanded_sequences,
    join_history,
    padded_sequences,
    running_lists,
    sequence_lists,
)
from funnelwright.operators.scorecard import feature_shift, month_summary, score_metrics
from funnelwright.plans.alert_daily import alert_requests, daily_history
from funnelwright.plans.alert_rca import RcaTables, analyze_alerts, driver_inputs
from funnelwright.plans.sequence_prep import PrepInputs, PrepParams, sequence_prep
from funnelwright.sources.batch import run_profile, run_queries
from funnelwright.sources.catalogs import catalog_from, metadata_from
from funnelwright.sources.tables import Source, cut_lineage, latest_rows, profile, read_table

WHOLE = ("1995-01-01", "2001-12-31")
CURRENT = ("1998-07-01", "2001-12-31")
BASELINE = ("1995-01-01", "1998-06-30")
TODAY = "2001-08-02"
RULES = FunnelRules(sample_rate=0.25, path_prefixes=("1-", "3-"), max_amount=150_000)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, Source(f"{sf}/{name}.parquet", "parquet"))


def money(c: Column | str) -> Column:
    """Sums of doubles differ in their last digits from run to run."""
    return F.round(c, 2)


def average(c: Column | str) -> Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- stand-in tables


def authorizations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cas_pkey"),
        F.col("o_custkey").alias("cm15"),
        F.col("o_custkey").alias("cm13"),
        F.substring("o_orderpriority", 1, 1).alias("appr_deny_cd"),
        F.to_date("o_orderdate").alias("trans_dt"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "P", "true").otherwise("false").alias("cancl_plastic_cd"),
        F.lit("1").alias("arm_proc_ind"),
        F.col("o_orderpriority").alias("cm11"),
        F.col("o_orderstatus").alias("country_cd"),
    )


def fraud_labels(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cas_pkey")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("lift_frd_in"),
        F.max("l_linestatus").alias("modl_id"),
        F.to_date(F.max("l_shipdate")).alias("first_id_dt"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cas_pkey"),
        F.to_date("o_orderdate").alias("trans_dt"),
        F.col("o_orderpriority").alias("lift_path_ds"),
    )
    return lines.join(orders, "cas_pkey")


def funnel_tables(spark: SparkSession, sf: str) -> FunnelTables:
    orders, customer, lines = (table(spark, sf, n) for n in ("orders", "customer", "lineitem"))
    analytics = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cas_pkey"),
        F.to_date("o_orderdate").alias("trans_dt"),
        F.when(F.col("c_acctbal") < 0, "1").otherwise("0").alias("zero_value_auth_ind"),
    )
    key = F.col("l_orderkey").alias("cas_pkey")
    return FunnelTables(
        authorizations=authorizations(spark, sf),
        labels=fraud_labels(spark, sf),
        analytics=analytics,
        credit_flags=lines.where(F.col("l_discount") == 0.1).select(key),
        referrals=lines.select(key, F.when(F.col("l_tax") == 0.08, "01").otherwise("99").alias("referral_rsn_cd")),
        first_party=customer.select(
            F.col("c_custkey").alias("cm13"),
            F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("frap_in"),
        ),
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("cas_pkey"),
        F.col("user_id").alias("cm15"),
        F.col("ts").alias("trans_ts"),
        F.to_date("ts").alias("trans_dt"),
        "event_type",
        "value",
    )


def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    return transactions(spark, sf).select(
        "cas_pkey", "trans_dt", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("lift_frd_in")
    )


# Example bucket rules; real ones are the user's. A large value leaves amount_buc null.
def event_rules() -> dict:
    value, hour = F.col("value"), F.hour("trans_ts")
    return {
        "amount_buc": [(value < 5, 1), (value < 20, 2), (value < 60, 3), (value < 200, 4)],
        "type_buc": [(F.col("event_type") == t, i) for i, t in enumerate(["view", "click", "purchase"], start=1)]
        + [(F.lit(True), 0)],
        "time_buc": [(hour < 6, 1), (hour < 18, 2), (F.lit(True), 3)],
    }


def event_features(spark: SparkSession, sf: str) -> DataFrame:
    rules = {**event_rules(), "age_in_days": age_in_days("trans_dt", "2024-03-01")}
    return bucketize(transactions(spark, sf), rules, ["cas_pkey"])


def event_spec(**changes: object) -> SequenceSpec:
    values = {"plain": {"amount": "amount_buc", "type": "type_buc"}, "gap": {"ngttime": ("age_in_days", "time_buc")}}
    return SequenceSpec(**{**values, **changes})


def event_history(spark: SparkSession, sf: str, max_history: int = 25, carried: DataFrame | None = None) -> DataFrame:
    rows = transactions(spark, sf)
    return history_map(
        rows, rows.select("cas_pkey"), "cm15", "trans_ts", max_history=max_history, lookback_days=20, block_rows=50, carried=carried
    )


def event_joined(spark: SparkSession, sf: str) -> DataFrame:
    history = event_history(spark, sf, carried=event_features(spark, sf))
    return join_history(history, None, event_labels(spark, sf), event_spec())


def feature_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.format_string("PRT_%06d", "p_partkey").alias("variable"),
        F.col("p_name").alias("full_name"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
        F.lit("orders").alias("table"),
        F.col("p_brand").alias("domain"),
        F.col("p_type").alias("model"),
        F.col("p_partkey").alias("file_order"),
    )


def feature_metadata(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.lit("")
    return table(spark, sf, "part").select(
        F.format_string("PRT_%06d", "p_partkey").alias("variable_id"),
        F.concat(F.lit("metric "), F.col("p_partkey").cast("string")).alias("variable_name"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
        F.lit("orders").alias("source_table"),
        F.col("p_brand").alias("segment"),
        F.col("p_type").alias("model_family"),
        blank.alias("use_case"),
        blank.alias("variable_type"),
        F.lit("urgent").alias("numerator_hint"),
        F.lit("amount").alias("denominator_hint"),
        blank.alias("owner_team"),
        F.array("p_type", "p_brand").alias("tags"),
        F.array(F.concat(F.lit("item "), F.col("p_partkey").cast("string"))).alias("aliases"),
        F.col("p_partkey").alias("file_order"),
    )


def alert_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One alert text per order."""
    code = F.concat(F.lit("RDMC"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    priority, day = F.col("o_orderpriority"), F.to_date("o_orderdate")
    text = (
        F.when(
            priority == "1-URGENT",
            F.concat(F.lit("lower-limit trouble with "), code, F.lit(", noticed "), F.date_format(day, "yyyy-MM-dd")),
        )
        .when(
            priority == "2-HIGH",
            F.concat(F.lit("COUNT alert of yesterday: variable "), code, F.lit(" in the canceled plastic model, xgboost gen 13")),
        )
        .when(
            priority == "3-MEDIUM",
            F.concat(
                F.lit("please look at the jump of merchant_rate for channel_"), F.col("o_orderstatus"),
                F.lit(" in us, "), F.date_format(day, "MMMM d"),
            ),
        )
        .when(
            priority == "4-NOT SPECIFIED",
            F.concat(F.lit("  control chart of authentication out of range, market GB, status "), F.col("o_orderstatus"), F.lit(" ")),
        )
        .otherwise(F.concat(F.lit("distribution shift of variable amt_"), F.col("o_orderstatus"), F.lit(" since Feb 30")))
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("alert_id"), text.alias("text"))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Order figures per month next to those of the month before; the month number is the alert id."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    sums = table(spark, sf, "orders").groupBy(month.cast("bigint").alias("alert_id")).agg(
        F.avg("o_totalprice").alias("metric"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.count(F.lit(1)).alias("base"),
        F.count_if(F.col("o_orderstatus") != "P").alias("noncanc"),
        F.count_if((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") >= 100_000)).alias("final_output"),
        F.count_if(F.col("o_totalprice") < 3_000).alias("tiny"),
    )
    before = sums.select((F.col("alert_id") + 1).alias("alert_id"), *[F.col(c).alias(f"{c}_0") for c in sums.columns[1:]])
    return sums.join(before, "alert_id", "left")


def monthly_metrics(months: DataFrame) -> DataFrame:
    pairs = {
        "metric_value": "metric", "baseline_value": "metric_0", "numerator_value": "urgent",
        "numerator_baseline": "urgent_0", "denominator_value": "base", "denominator_baseline": "base_0",
    }
    rounded = {k: F.round(F.col(v), 4) for k, v in pairs.items()}
    return months.select("alert_id", *[c.alias(k) for k, c in rounded.items()])


def monthly_stages(months: DataFrame) -> DataFrame:
    items = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.col(s).alias("current"), F.col(f"{s}_0").alias("baseline"))
            for s in ("base", "noncanc", "final_output")
        ]
    )
    return months.select("alert_id", F.inline(items))


def monthly_checks(months: DataFrame) -> DataFrame:
    """No check row for months without small orders: those get the default checks."""
    status = F.when(F.col("tiny") > 2, "FAIL").otherwise(F.lit(None).cast("string"))
    return months.where(F.col("tiny") > 0).select(
        "alert_id", F.lit("small_orders").alias("name"), status.alias("status"), F.col("tiny").cast("string").alias("details")
    )


def monthly_alerts(months: DataFrame) -> DataFrame:
    types = F.array(*map(F.lit, ["lower_limit_breach", "count_alert", "distribution_shift"]))
    day = F.make_date(F.floor((F.col("alert_id") - 1) / 12).cast("int"), ((F.col("alert_id") - 1) % 12 + 1).cast("int"), F.lit(28))
    blank = F.lit("")
    metadata = F.struct(
        F.concat(F.lit("VAR"), F.col("alert_id").cast("string")).alias("variable_id"),
        blank.alias("variable_name"),
        F.when(F.col("alert_id") % 2 == 0, "Average order value.").otherwise("").alias("description"),
        F.lit("orders").alias("source_table"),
        blank.alias("segment"),
        blank.alias("model_family"),
        F.when(F.col("alert_id") % 2 == 0, "urgent orders").otherwise("").alias("numerator_hint"),
        blank.alias("denominator_hint"),
    )
    alerts = months.select(
        "alert_id",
        F.concat(F.lit("alert "), F.col("alert_id").cast("string")).alias("raw_user_query"),
        day.alias("alert_date"),
        F.get(types, (F.col("alert_id") % 3).cast("int")).alias("alert_type"),
        F.lit("ratio").alias("metric_view"),
        F.lit(0.99).alias("parse_confidence"),
        blank.alias("model_hint"),
        blank.alias("segment_hint"),
        blank.alias("market_hint"),
        blank.alias("analyst_notes"),
        metadata.alias("metadata"),
    )
    return derive_windows(alerts)


def monthly_drivers(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn(
        "alert_id", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint")
    )
    counts = segment_counts(
        orders, {"mcc": F.col("o_orderpriority"), "country": F.col("o_orderstatus")}, F.col("o_totalprice"), ["alert_id"]
    )
    return driver_package(top_per_dimension(counts, ["alert_id"]), ["alert_id"])


def monthly_package(spark: SparkSession, sf: str) -> DataFrame:
    months = monthly(spark, sf)
    return rca.rca_package(
        monthly_alerts(months), monthly_metrics(months), monthly_stages(months), monthly_drivers(spark, sf), monthly_checks(months)
    )


# ---------------------------------------------------------------- queries


def driver_top_segments(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where(in_dates(F.to_date("l_shipdate"), *WHOLE))
    top = top_segments(lines, "l_suppkey", "l_extendedprice")
    return top.withColumn("total_amt", money("total_amt"))


def driver_all_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    rows = join_labels(authorizations(spark, sf), fraud_labels(spark, sf), ["cas_pkey", "trans_dt"], "lift_frd_in")
    dimensions = {
        "mcc": F.col("cm11"), "country": F.col("country_cd"), "model_id": F.col("modl_id"),
        "lift_path": F.col("lift_path_ds"), "cm15": F.col("cm15"),
    }
    top = top_per_dimension(segment_counts(rows, dimensions, F.col("amount")))
    return top.withColumn("total_amt", money("total_amt"))


def daily_metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    daily = with_delta(daily_metric(authorizations(spark, sf).where(in_dates("trans_dt", *WHOLE)), "trans_dt", "amount"))
    return daily.withColumns({c: average(c) for c in ("avg_metric", "metric_delta")}).orderBy("trans_dt")


def sample_by_label(spark: SparkSession, sf: str) -> DataFrame:
    labels = fraud_labels(spark, sf).select("cas_pkey", "trans_dt", "lift_frd_in")
    rows = authorizations(spark, sf).select("cas_pkey", "trans_dt")
    return label_preserving_sample(rows, labels, "cas_pkey", ["cas_pkey", "trans_dt"], "lift_frd_in", 0.1)


def stage_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return stage_counts(funnel_tables(spark, sf), {"current": CURRENT, "baseline": BASELINE}, RULES)


def stage_funnel_chained(spark: SparkSession, sf: str) -> DataFrame:
    return count_frames(stage_frames(funnel_tables(spark, sf), *WHOLE, RULES, cut_lineage))


def funnel_final_rows(spark: SparkSession, sf: str) -> DataFrame:
    final = stage_frames(funnel_tables(spark, sf), *WHOLE, RULES)["notff"]
    return final.select("cas_pkey", "trans_dt", "amount", "lift_frd_in", "app_flag", "poldec_flag")


def funnel_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    counts = stage_funnel(spark, sf)
    pivoted = counts.groupBy("stage").agg(
        F.max(F.when(F.col("period") == "current", F.col("row_count"))).alias("current"),
        F.max(F.when(F.col("period") == "baseline", F.col("row_count"))).alias("baseline"),
    )
    found = rca.stage_diagnostics(pivoted.withColumn("alert_id", F.lit(1)))
    return found.select(F.inline("stage_diagnostics")).withColumn("pct_change", F.round("pct_change", 9))


def alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_package(spark, sf).select("alert_id", "alert_summary.*").withColumn(
        "pct_change", F.round("pct_change", 9)
    )


def metric_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    package = monthly_package(spark, sf)
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), *[F.col(f"metric_decomposition.{s}.{f}").alias(f) for f in ("label", "value", "baseline", "pct_change")])
            for s in ("numerator", "denominator")
        ]
    )
    return package.select("alert_id", F.inline(sides)).withColumn("pct_change", F.round("pct_change", 9))


def stage_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    package = monthly_package(spark, sf)
    return package.select("alert_id", F.inline("stage_diagnostics")).withColumn("pct_change", F.round("pct_change", 9))


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    ranked = monthly_package(spark, sf).select("alert_id", F.posexplode("hypotheses").alias("position", "h"))
    return ranked.select(
        "alert_id", "position", "h.hypothesis", "h.confidence", F.array_join("h.evidence", "; ").alias("evidence")
    )


def dq_checks(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_package(spark, sf).select("alert_id", F.inline("data_quality_checks"))


def driver_packages(spark: SparkSession, sf: str) -> DataFrame:
    package = monthly_package(spark, sf)
    rows = F.array(
        *[F.struct(F.lit(k).alias("dimension"), F.col(f"top_drivers.{k}").alias("segments")) for k in ("mcc", "country", "cm15")]
    )
    flat = package.select("alert_id", F.inline(rows))
    return flat.select(
        "alert_id",
        "dimension",
        F.size("segments").cast("bigint").alias("segment_count"),
        F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["segment_value"], s["cnt"])), "|").alias("segments"),
    )


def rca_package(spark: SparkSession, sf: str) -> DataFrame:
    return rca.full(monthly_package(spark, sf)).select(
        "alert_id",
        F.col("analysis_window.start_date").alias("start_date"),
        F.col("analysis_window.end_date").alias("end_date"),
        F.col("baseline_window.start_date").alias("baseline_start_date"),
        F.col("baseline_window.end_date").alias("baseline_end_date"),
        F.col("input_context.resolved_variable_name").alias("resolved_variable_name"),
        F.col("alert_summary.alert_direction").alias("alert_direction"),
        F.size("stage_diagnostics").cast("bigint").alias("stage_rows"),
        "analyst_summary",
    )


def rca_compact(spark: SparkSession, sf: str) -> DataFrame:
    short = rca.compact(monthly_package(spark, sf))
    found = F.col("key_findings")
    return short.select(
        "alert_id",
        F.array_join(F.transform(found["flagged_stages"], lambda s: s["stage"]), ",").alias("flagged_stages"),
        F.array_join(F.transform(found["top_hypotheses"], lambda h: h["confidence"].cast("string")), ",").alias("confidences"),
        F.col("metric_decomposition").isNotNull().alias("has_decomposition"),
    )


def history_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = transactions(spark, sf)
    sample = rows.where(F.col("event_type") == "purchase").select("cas_pkey")
    return history_map(rows, sample, "cm15", "trans_ts", lookback_days=5, block_rows=50)


def bucketed_features(spark: SparkSession, sf: str) -> DataFrame:
    return event_features(spark, sf)


def sequence_running_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = running_lists(event_joined(spark, sf), event_spec())
    return lists.select("cas_pkey", "lift_frd_in", *[F.array_join(c, ",").alias(c) for c in event_spec().columns])


def sequence_padded(spark: SparkSession, sf: str) -> DataFrame:
    spec = event_spec()
    lists = sequence_lists(event_joined(spark, sf), spec)
    return expanded_sequences(padded_sequences(lists, spec), spec)


def sequence_latest(spark: SparkSession, sf: str) -> DataFrame:
    spec = event_spec(keep="latest", align=True)
    joined = join_history(event_history(spark, sf), event_features(spark, sf), event_labels(spark, sf), spec)
    return expanded_sequences(padded_sequences(sequence_lists(joined, spec), spec), spec, positional=True)


def sequence_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = transactions(spark, sf)
    inputs = PrepInputs(
        transactions=rows,
        labels=event_labels(spark, sf),
        features=rows,
        rules={**event_rules(), "age_in_days": age_in_days("trans_dt", "2024-03-01")},
        exclusions=[Exclusion(rows.where(F.col("event_type") == "signup"), "cas_pkey")],
        keep=F.col("value") >= 1,
    )
    params = PrepParams("2024-01-01", "2024-01-31", 0.2, lookback_days=10)
    return sequence_prep(inputs, params, event_spec())


def newest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return latest_rows(table(spark, sf, "events"), "event_type <> 'view'", 500, "ts", ("event_id",)).drop("props")


def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    names = ["orders", "lineitem", "customer", "events", "part"]
    return profile({n: table(spark, sf, n) for n in names}, {"orders": "o_orderstatus = 'F'", "events": F.col("value") > 10})


def sql_batch(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("batch_orders")
    runs = run_queries(
        spark,
        [
            ("by_day", "SELECT o_orderdate, count(*) AS n FROM batch_orders GROUP BY 1"),
            ("missing", "SELECT nothing FROM batch_orders"),
            ("blank", "  "),
            ("urgent", "SELECT * FROM batch_orders WHERE o_orderpriority = '1-URGENT'"),
        ],
    )
    return run_profile(spark, runs).select("name", "status", "row_count")


def code_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A code per line item, written in three ways; some codes do not exist."""
    number = F.format_string("%06d", F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0))
    code = (
        F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("PRT_"), number))
        .when(F.col("l_linenumber") <= 5, F.concat(F.lit(" prt-"), number))
        .otherwise(F.concat(F.lit("Prt "), number))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", code.alias("code"))


def catalog_exact(spark: SparkSession, sf: str) -> DataFrame:
    found = lookups.exact_lookup(code_requests(spark, sf), feature_catalog(spark, sf))
    return found.select("l_orderkey", "l_linenumber", "code", F.col("record.full_name").alias("full_name"))


def catalog_filter(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.filter_catalog(feature_catalog(spark, sf), model="eco-nomy").select("variable", "domain", "model")


def swapped_names(spark: SparkSession, sf: str) -> DataFrame:
    """Per part a query text: its name with the words swapped."""
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("  ", F.get(words, F.lit(1)), F.get(words, F.lit(0))).alias("query"), F.col("p_type").alias("model")
    )


def catalog_word_search(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), F.element_at(F.split("p_name", " "), -1)).alias("query"))
    found = lookups.word_search(requests, feature_catalog(spark, sf), 5)
    return found.select("p_partkey", "variable", F.round("score", 6).alias("score"), "result_rank")


def catalog_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    found = lookups.search(swapped_names(spark, sf), feature_catalog(spark, sf), 3)
    first = F.get("results", F.lit(0))
    return found.select(
        "p_partkey", "total_matches", F.size("results").alias("shown"),
        first["variable"].alias("variable"), F.round(first["score"], 6).alias("score"),
    )


def variable_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all kinds per part: exact code, unknown code, text, filters only, nothing."""
    p = F.col("p_partkey") % 5
    requests = table(spark, sf, "part").select(
        "p_partkey",
        F.when(p == 0, F.format_string("prt %06d", "p_partkey")).when(p == 1, F.concat(F.lit("prt "), F.col("p_brand"))).alias("code"),
        F.when(p == 2, F.concat_ws(" ", "p_type", "p_name")).alias("query"),
        F.when(p.isin(2, 3), F.col("p_type")).alias("model"),
        F.when(p == 3, F.col("p_brand")).alias("domain"),
    )
    found = lookups.lookup(requests, feature_catalog(spark, sf))
    return found.select(
        "p_partkey", "status", "match_type", "result_count", "total_matches",
        F.get("results", F.lit(0))["variable"].alias("variable"), "message",
    )


def filtered_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Filter-only lookups, one per supplier: by model, by model and domain, or none that exists."""
    models = F.array(*map(F.lit, ["economy", "Small", "pro-mo", "unknown"]))
    requests = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.get(models, (F.col("s_suppkey") % 4).cast("int")).alias("model"),
        F.when(F.col("s_nationkey") > 5, F.concat(F.lit("brand "), F.col("s_nationkey").cast("string"))).alias("domain"),
    )
    found = lookups.lookup(requests, feature_catalog(spark, sf))
    return found.select("s_suppkey", "status", "match_type", "result_count", F.array_join(F.transform("results", lambda r: r["variable"]), ",").alias("variables"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """A variable reference per line item: by id, alias, part of a description, or unknown."""
    part, line = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    ref = (
        F.when(line <= 2, F.format_string("prt-%06d", "l_partkey"))
        .when(line == 3, F.concat(F.lit("ITEM_"), part))
        .when(line == 4, F.concat(F.lit("Metric "), part))
        .when(line == 5, F.concat(F.lit("brand#"), (F.col("l_suppkey") % 30).cast("string"), F.lit(" e")))
        .when(line == 6, F.lit("--"))
        .otherwise(F.concat(F.lit("no such thing "), F.col("l_returnflag")))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", ref.alias("variable_reference"))


def resolve_reference(spark: SparkSession, sf: str) -> DataFrame:
    found = lookups.resolve(
        references(spark, sf), feature_metadata(spark, sf),
        candidate=lambda record: record["variable_id"], listed=lambda ids: F.array_join(ids, ","),
    )
    return found.select(
        "l_orderkey", "l_linenumber", "variable_reference", "resolution", "match_stage", "candidate_count", "candidates"
    )


def parsed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return parse_alerts(alert_texts(spark, sf), "text", TODAY).drop("text", "analyst_notes")


def structured_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests given as columns, one per customer, with windows."""
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("alert_id"),
        F.when(F.col("c_nationkey") < 12, F.concat(F.lit("CM"), F.col("c_nationkey").cast("string"))).alias("variable_id"),
        F.concat(F.lit("name_"), F.lower("c_mktsegment")).alias("variable_name"),
        F.when(F.col("c_acctbal") < 3000, "2001-03-05").alias("alert_date"),
        F.when(F.col("c_acctbal") > 0, "ratio_spike").otherwise("unknown").alias("alert_type"),
        F.when(F.col("c_nationkey") > 20, "seen as decline of volume in DE").alias("analyst_notes"),
        F.when(F.col("c_nationkey") == 3, F.lit("2001-01-31")).cast("date").alias("end_date"),
    )
    parsed = derive_windows(parse_structured_alerts(requests, TODAY))
    return parsed.drop("analyst_notes")


def recent_context(spark: SparkSession, sf: str) -> DataFrame:
    return chatlog.recent_context(table(spark, sf, "conversations"), max_items=4, max_chars=120)


def response_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls read from answers composed around every conversation message."""
    text = F.to_json(F.struct(F.col("text").alias("note"), "turn"))
    call = F.concat(F.lit('{"plan": ["look up", " "], "tools": [{"name": "variable_lookup", "argument": '), text, F.lit('}], "next_action": "done"}'))
    quoted = F.concat(F.lit('{"tools": [{"name": "data_prep", "argument": "{"conv": '), F.col("conv_id").cast("string"), F.lit('}"}]}'))
    composed = (
        F.when(F.col("role") == "user", F.concat(F.lit("Sure:\n```json\n"), call, F.lit("\n```")))
        .when(F.col("role") == "system", quoted)
        .otherwise(F.concat(F.lit("Here it is "), call, F.lit(" as asked")))
    )
    answers = table(spark, sf, "conversations").select("conv_id", "turn", composed.alias("answer_text"))
    calls = chatlog.tool_calls(chatlog.parse_responses(answers, "answer_text"), ["conv_id", "turn", "next_action"])
    argument = F.col("argument")
    return calls.select(
        "conv_id", "turn", "next_action", "call_order", "tool_name",
        F.get_json_object(argument, "$.note").alias("note"), F.get_json_object(argument, "$.conv").alias("conv"),
    )


def response_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The four other shapes of an answer, read from texts with and without JSON."""
    item = F.concat(F.lit("case "), F.col("conv_id").cast("string"))
    fields = F.struct(
        F.concat(F.lit(" "), item).alias("intent_summary"), F.array(item, F.lit(" two ")).alias("constraints"),
        F.lit("ASK").alias("task_type"), F.array("role").alias("recommended_tools"), F.col("turn").alias("message"),
        F.col("turn").alias("finding_summary"), F.lit(" small ").alias("confidence_and_limitations"),
    )
    text = F.when(F.col("role") == "user", F.concat(F.lit("So: "), F.to_json(fields), F.lit(" - that is all"))).when(
        F.col("role") == "assistant", F.concat(F.lit(" plain "), item)
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", text.alias("answer_text"))
    for shape in ("intent", "routing", "conversation", "evaluation"):
        rows = chatlog.parse_responses(rows, "answer_text", shape)
    lists = ("success_criteria", "constraints", "recommended_tools", "risks_or_gaps")
    return rows.withColumns({c: F.array_join(c, ",") for c in lists}).drop("answer_text")


def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One structured alert per order, about a part of the catalog; some also quote another part."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("alert_id"),
        F.format_string("PRT_%06d", "o_custkey").alias("variable_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("alert_date"),
        F.lit("lower_limit_breach").alias("alert_type"),
        F.when(
            (F.col("o_orderpriority") == "2-HIGH") & (F.year("o_orderdate") >= 2000),
            F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" the variable item_5 saw a drop")),
        ).alias("user_query"),
    )


def alert_history(spark: SparkSession, sf: str) -> DataFrame:
    """Daily history of the week before each alert; the metric column depends on the part's type."""
    metadata = feature_metadata(spark, sf).withColumn(
        "variable_name", F.when(F.col("model_family").isin("ECONOMY", "SMALL"), "line_count").otherwise("amount")
    )
    alerts = alert_rows(spark, sf).withColumn("start_date", F.date_sub(F.to_date("alert_date"), 6))
    rows = authorizations(spark, sf).withColumn("line_count", F.length("cm11").cast("double"))
    history = daily_history(
        alert_requests(alerts, metadata, TODAY), {"orders": rows}, {"orders": ["amount", "line_count"]}
    )
    return history.withColumns({c: average(c) for c in ("avg_metric", "metric_delta")})


def profiled_tables(spark: SparkSession, sf: str) -> dict[str, Profiled]:
    """Tables behind the alerts, with their keys; some lines lack theirs."""
    lines = table(spark, sf, "lineitem").select(
        F.when((F.col("l_linenumber") < 7) | (F.col("l_tax") < 0.08), F.col("l_orderkey")).alias("order_key"), F.to_date("l_shipdate").alias("shipped")
    )
    return {"orders": Profiled(authorizations(spark, sf), ["cas_pkey", "cm13"]), "lines": Profiled(lines, ["order_key"], "shipped")}


def alert_rca(spark: SparkSession, sf: str) -> DataFrame:
    """The whole analysis for every alert: parse, resolve, funnel, drivers of both windows, checks, metric, findings."""
    rows = authorizations(spark, sf)
    funnel = funnel_tables(spark, sf)
    driver_rows, dimensions = driver_inputs(funnel)
    tables = RcaTables(
        funnel=funnel,
        rules=RULES,
        driver_rows=driver_rows,
        dimensions=dimensions,
        amount=F.col("amount"),
        metric_rows=rows,
        metrics={"urgent": F.when(F.col("cm11") == "1-URGENT", F.col("amount")), "amount": F.col("amount")},
        profiled=profiled_tables(spark, sf),
    )
    found = analyze_alerts(alert_rows(spark, sf), feature_metadata(spark, sf), tables, TODAY)
    stage = F.get(F.filter("stage_diagnostics", lambda s: s["flagged"]), F.lit(0))

    def first(package: str, key: str) -> Column:
        return F.get(f"{package}.{key}", F.lit(0))

    def named(package: str, *fields: str) -> Column:
        """``key=segment`` (and more) of the first segment of each key that has one."""
        texts = [
            F.when(F.size(f"{package}.{k}") > 0, F.concat(F.lit(f"{k}="), F.concat_ws(":", *[F.coalesce(first(package, k)[f].cast("string"), F.lit("none")) for f in fields])))
            for k in PACKAGE_KEYS
        ]
        return F.when(F.col("status") == "success", F.concat_ws(",", *texts))

    def total(field: str) -> Column:
        return reduce(Column.__add__, [F.coalesce(first("driver_changes", k)[field], F.lit(0.0)) for k in PACKAGE_KEYS])

    each = lambda field: F.array_join(F.transform("data_quality_checks", lambda c: c[field]), "|")
    return found.select(
        "alert_id",
        "status",
        F.col("resolved_variable_metadata.variable_id").alias("variable_id"),
        F.col("analysis_window.start_date").alias("start_date"),
        F.col("baseline_window.start_date").alias("baseline_start_date"),
        average("metric_decomposition.numerator.value").alias("numerator_value"),
        average("metric_decomposition.denominator.baseline").alias("denominator_baseline"),
        F.round(F.col("stage_diagnostics")[0]["current_count"], 6).alias("base_per_day"),
        F.round(F.col("stage_diagnostics")[0]["baseline_count"], 6).alias("base_per_day_before"),
        stage["stage"].alias("flagged_stage"),
        F.get("top_drivers.mcc", F.lit(0))["segment_value"].alias("top_mcc"),
        F.get("top_drivers.mcc", F.lit(0))["cnt"].alias("top_mcc_cnt"),
        named("top_drivers", "segment_value", "cnt").alias("drivers"),
        named("baseline_drivers", "segment_value", "cnt").alias("drivers_before"),
        named("driver_changes", "segment_value").alias("changed"),
        F.when(F.col("status") == "success", average(total("change"))).alias("changed_by"),
        F.when(F.col("status") == "success", average(total("mix_effect"))).alias("changed_by_mix"),
        each("status").alias("check_status"),
        each("details").alias("check_details"),
    )


def computed_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The computed checks of a three-day window against four weeks before, for every day with an order."""
    tables = profiled_tables(spark, sf)
    days = authorizations(spark, sf).select(F.col("trans_dt").alias("alert_date")).distinct()
    found = window_checks(daily_profile(tables), derive_windows(days), list(tables), ["alert_date"])
    return found.drop("position")


def draws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(key_uniform("o_orderkey"), 9).alias("u"))


def messy_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata sheet with odd headers, blanks and list cells, read into its thirteen fields."""
    key = F.col("p_partkey").cast("string")
    sheet = table(spark, sf, "part").select(
        F.concat(F.lit("  PRT_"), key, F.lit(" \n ")).alias("Variable"),
        F.concat("p_name", F.lit(" \t  "), "p_brand").alias("Full_Name"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias(" Business_Definition"),
        F.lit("first").alias("Type"),
        F.concat("p_type", F.lit("  ")).alias("Variable_Type"),
        F.concat(F.lit(" item "), key, F.lit(" |, "), "p_brand", F.lit(",, ")).alias("SYNONYMS"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat("p_type", F.lit("|"), "p_brand")).alias("tags"),
        F.lit("not read").alias("Comment"),
        F.col("p_partkey").alias("file_order"),
    )
    lists = {c: F.array_join(c, ";") for c in ("aliases", "tags")}
    return metadata_from(sheet).withColumns(lists).select(
        "file_order", "variable_id", "variable_name", "description", "variable_type", "owner_team", "aliases", "tags"
    )


def messy_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog sheet with odd headers; of two headers for one field the last wins."""
    sheet = table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_name", F.lit("  x ")).alias("VARIABLE"),
        F.col("p_brand").alias("Full-Name"),
        F.when(F.col("p_size") > 25, F.concat("p_type", F.lit(" \n "), "p_brand")).alias("full__name "),
        F.lit(None).cast("string").alias("Table"),
        F.col("p_size").alias("Domain"),
        F.col("p_partkey").alias("file_order"),
    )
    return catalog_from(sheet)


def numbers_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers read from texts, some of which are none."""
    key, priority = F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", key)
        .when(priority == "2-HIGH", F.concat(F.lit("-"), key, F.lit(".25")))
        .when(priority == "3-MEDIUM", F.concat(key, F.lit(" units")))
        .when(priority == "4-NOT SPECIFIED", "")
    )
    orders = table(spark, sf, "orders").withColumn("number_text", text)
    return orders.select("o_orderkey", "number_text", safe_double("number_text").alias("number"))


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with a score (some without, some in steps, so that many are tied) and a label (open ones without)."""
    score = F.when(F.col("l_suppkey") % 3 == 0, F.floor(F.col("l_extendedprice") / 5000) * 5000).otherwise(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") < 7, score).alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("label"),
        F.col("l_linestatus").alias("line_status"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("line"),
    )


def scored_table(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, hit rate, accuracy, KS and Gini of the scored lines, as a whole and by segment."""
    segments = {"line_status": F.col("line_status"), "line": F.col("line")}
    found = score_metrics(scored_lines(spark, sf), F.col("score"), F.col("label"), 40_000, segments)
    return found.withColumns({c: F.round(c, 9) for c in ("coverage", "hitrate", "accuracy", "gini", "ks")})


def month_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Shift of three features of the lines shipped in May and June 1998."""
    lines = table(spark, sf, "lineitem")
    features = {
        "quantity": F.when(F.col("l_linenumber") < 7, F.col("l_quantity")),
        "price": F.col("l_extendedprice"),
        "discount": F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("date"), F.col("l_discount")),
    }
    summary = month_summary(lines, F.date_format("l_shipdate", "yyyy-MM"), features, {"price": 100})
    shift = feature_shift(summary, "1998-06", "1998-05")
    kept = ("feature", "n_current", "n_baseline")
    return shift.select(*kept, *[F.round(c, 6).alias(c) for c in shift.columns if c not in kept])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "driver_top_segments": driver_top_segments,
    "driver_all_dimensions": driver_all_dimensions,
    "daily_metric_delta": daily_metric_delta,
    "key_draws": draws,
    "label_preserving_sample": sample_by_label,
    "stage_funnel": stage_funnel,
    "stage_funnel_chained": stage_funnel_chained,
    "funnel_final_rows": funnel_final_rows,
    "funnel_diagnostics": funnel_diagnostics,
    "alert_summary": alert_summary,
    "metric_decomposition": metric_decomposition,
    "stage_diagnostics": stage_diagnostics,
    "dq_checks": dq_checks,
    "driver_packages": driver_packages,
    "hypotheses": hypotheses,
    "rca_package": rca_package,
    "rca_compact": rca_compact,
    "alert_rca": alert_rca,
    "computed_checks": computed_checks,
    "alert_history": alert_history,
    "history_pairs": history_pairs,
    "bucketed_features": bucketed_features,
    "sequence_running_lists": sequence_running_lists,
    "sequence_padded": sequence_padded,
    "sequence_latest": sequence_latest,
    "sequence_training_rows": sequence_training_rows,
    "latest_rows": newest_rows,
    "table_profile": table_profile,
    "sql_batch": sql_batch,
    "catalog_exact": catalog_exact,
    "catalog_filter": catalog_filter,
    "catalog_filtered_lists": filtered_listing,
    "catalog_word_search": catalog_word_search,
    "catalog_fuzzy": catalog_fuzzy,
    "variable_lookup": variable_lookup,
    "resolve_reference": resolve_reference,
    "parse_alerts": parsed_alerts,
    "structured_alerts": structured_alerts,
    "recent_context": recent_context,
    "response_tools": response_tools,
    "response_shapes": response_shapes,
    "messy_metadata": messy_metadata,
    "messy_catalog": messy_catalog,
    "numbers_from_text": numbers_from_text,
    "score_metrics": scored_table,
    "feature_shift": month_shift,
}
