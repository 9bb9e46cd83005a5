"""Filter-funnel counts of the authorization stream.

Two forms with equal counts:

* ``stage_frames`` chains the stages as DataFrames, with the joins and their fan-out as
  written; use it to look at the rows of a stage.
* ``funnel_cells`` / ``stage_counts`` count all stages in one pass. The side tables are
  aggregated to one row per key before the join, so a join never multiplies rows: the
  fan-out becomes a weight, and a stage count is the sum of the weights still alive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.functions.measures import as_date
from funnelwright.operators.daily import days_of
from funnelwright.operators.sampling import (
    DEFAULT_SAMPLE_RATE,
    MATURITY_DAYS,
    drawn_keys_only,
    label_preserving_sample,
    maturity_rule,
)

# Stage names in order, and the codes and limits of the rules.
STAGES = [
    "base", "with_zva", "with_ff", "noncanc", "nonzva", "dedupe", "with_poldec", "non_derived", "notfrap", "notff",
]
APPROVAL_CODES = ["0", "1", "6"]
POLICY_DECLINE_CODES = ["01", "03", "06", "09", "11", "14", "18"]
FRIENDLY_PATH_PREFIXES = ["1.", "3."]
FRIENDLY_MAX_AMOUNT = 50


@dataclass(frozen=True)
class FunnelRules:
    """Codes and limits of the stages."""

    processed: str = "1"
    not_canceled: str = "false"
    approval_codes: tuple[str, ...] = tuple(APPROVAL_CODES)
    policy_codes: tuple[str, ...] = tuple(POLICY_DECLINE_CODES)
    path_prefixes: tuple[str, ...] = tuple(FRIENDLY_PATH_PREFIXES)
    max_amount: float = FRIENDLY_MAX_AMOUNT
    sample_rate: float = DEFAULT_SAMPLE_RATE
    maturity_days: int = MATURITY_DAYS


@dataclass(frozen=True)
class FunnelTables:
    """The inputs, with the columns each must have.

    authorizations: cas_pkey, cm15, cm13, appr_deny_cd, trans_dt, amount, cancl_plastic_cd, arm_proc_ind
    labels: cas_pkey, trans_dt, lift_frd_in, modl_id, lift_path_ds, first_id_dt
    analytics: cas_pkey, trans_dt, zero_value_auth_ind
    credit_flags: cas_pkey
    referrals: cas_pkey, referral_rsn_cd
    first_party: cm13, frap_in
    """

    authorizations: DataFrame
    labels: DataFrame
    analytics: DataFrame
    credit_flags: DataFrame
    referrals: DataFrame
    first_party: DataFrame


def code_flag(code: Column | str, codes: Sequence[str]) -> Column:
    """1 if the code is in the set, else 0; a null code gives 0."""
    code = F.col(code) if isinstance(code, str) else code
    return F.when(code.isin(*codes), 1).otherwise(0)


def zero_value_ok(flag: Column | str) -> Column:
    """Flag is numerically 0, or missing."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return (flag.try_cast("bigint") == 0) | flag.isNull()


def not_friendly_fraud(rules: FunnelRules) -> Column:
    """NOT (label 1, listed path prefix, small amount); unknown counts as not kept, as in SQL WHERE."""
    return ~(
        (F.col("lift_frd_in") == 1)
        & F.substring("lift_path_ds", 1, 2).isin(*rules.path_prefixes)
        & (F.col("amount") <= rules.max_amount)
    )


def sampled_authorizations(tables: FunnelTables, rules: FunnelRules, days: Column) -> DataFrame:
    """Processed authorizations of the days, labelled and sampled (label maturity not yet applied)."""
    auth = tables.authorizations.where(days & (F.col("arm_proc_ind") == rules.processed)).select(
        "cas_pkey", "cm15", "cm13", "appr_deny_cd", "trans_dt", "amount", F.col("cancl_plastic_cd").alias("plstcnci")
    )
    labels = tables.labels.where(days).select(
        "cas_pkey", "trans_dt", "lift_frd_in", "modl_id", "lift_path_ds", "first_id_dt"
    )
    return label_preserving_sample(
        auth, labels, "cas_pkey", ["cas_pkey", "trans_dt"], "lift_frd_in", rules.sample_rate
    )


def stage_frames(
    tables: FunnelTables,
    start: str | Column,
    end: str | Column,
    rules: FunnelRules = FunnelRules(),
    staged: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """The rows of every stage of one window, by stage name.

    ``staged`` is applied after every join; with ``cut_lineage`` a caller that reads several frames
    runs each join once, not once for each frame behind it.
    """
    days = F.col("trans_dt").between(as_date(start), as_date(end))
    key_date = ["cas_pkey", "trans_dt"]
    base = staged(
        sampled_authorizations(tables, rules, days).where(maturity_rule("first_id_dt", as_date(end), rules.maturity_days))
    )
    analytics = tables.analytics.where(days).select(*key_date, "zero_value_auth_ind")
    with_zva = staged(base.join(analytics, key_date, "inner"))
    with_ff = with_zva.withColumn("app_flag", code_flag("appr_deny_cd", rules.approval_codes))
    noncanc = with_ff.where(F.col("plstcnci") == rules.not_canceled)
    nonzva = noncanc.where(zero_value_ok("zero_value_auth_ind"))
    dedupe = staged(nonzva.join(tables.credit_flags.select("cas_pkey"), "cas_pkey", "left_anti"))
    referrals = tables.referrals.select("cas_pkey", "referral_rsn_cd")
    with_poldec = staged(
        dedupe.join(referrals, "cas_pkey", "left")
        .withColumn("poldec_flag", code_flag("referral_rsn_cd", rules.policy_codes))
        .drop("referral_rsn_cd")
    )
    non_derived = with_poldec.where(F.col("poldec_flag") != 1)
    abusers = tables.first_party.where(F.col("frap_in") == 1).select("cm13")
    notfrap = staged(non_derived.join(abusers, "cm13", "left_anti"))
    notff = notfrap.where(not_friendly_fraud(rules))
    frames = [base, with_zva, with_ff, noncanc, nonzva, dedupe, with_poldec, non_derived, notfrap, notff]
    return dict(zip(STAGES, frames))


def count_frames(frames: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of one count per frame: stage, stage_order, row_count."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("stage"), F.lit(order).alias("stage_order"), "row_count"
        )
        for order, (name, df) in enumerate(frames.items(), start=1)
    ]
    return reduce(DataFrame.unionByName, rows)


def weighted_rows(tables: FunnelTables, rules: FunnelRules, days: Column) -> DataFrame:
    """Sampled authorizations with one weight column per stage (rows the stage chain would hold)."""
    base = sampled_authorizations(tables, rules, days)
    labels = tables.labels.where(days)

    def sampled_keys(side: DataFrame) -> DataFrame:
        return drawn_keys_only(side, labels, "cas_pkey", "lift_frd_in", rules.sample_rate)

    analytics = tables.analytics.where(days).select("cas_pkey", "trans_dt", "zero_value_auth_ind")
    analytics = sampled_keys(analytics).groupBy("cas_pkey", "trans_dt").agg(
        F.count(F.lit(1)).alias("zva_rows"), F.count_if(zero_value_ok("zero_value_auth_ind")).alias("zva_ok_rows")
    )
    # Both tables below are keyed by cas_pkey: one union, one aggregation, one join.
    not_policy = 1 - code_flag("referral_rsn_cd", rules.policy_codes)
    credit = tables.credit_flags.select("cas_pkey", F.lit(1).alias("credit"), F.lit(0).alias("ref"), F.lit(0).alias("ok"))
    referral = tables.referrals.select("cas_pkey", F.lit(0).alias("credit"), F.lit(1).alias("ref"), not_policy.alias("ok"))
    by_key = sampled_keys(credit.unionByName(referral)).groupBy("cas_pkey").agg(
        F.max("credit").alias("credit"), F.sum("ref").alias("ref_rows"), F.sum("ok").alias("ref_ok_rows")
    )
    abusers = tables.first_party.where(F.col("frap_in") == 1).select("cm13").distinct().withColumn("abuser", F.lit(1))
    joined = (
        base.join(analytics, ["cas_pkey", "trans_dt"], "left")
        .join(by_key, "cas_pkey", "left")
        .join(abusers, "cm13", "left")
    )

    def alive(condition: Column, weight: Column) -> Column:
        return F.when(condition, weight).otherwise(0)

    zero = F.lit(0).cast("bigint")
    has_referral = F.coalesce(F.col("ref_rows"), zero) > 0
    joined = joined.withColumns(
        {
            "base": F.lit(1).cast("bigint"),
            "with_zva": F.coalesce("zva_rows", zero),
            "with_ff": F.coalesce("zva_rows", zero),
        }
    )
    kept_plastic = F.col("plstcnci") == rules.not_canceled
    joined = joined.withColumn("noncanc", alive(kept_plastic, F.col("with_ff")))
    joined = joined.withColumn("nonzva", alive(kept_plastic, F.coalesce("zva_ok_rows", zero)))
    joined = joined.withColumn("dedupe", alive(F.coalesce("credit", F.lit(0)) == 0, F.col("nonzva")))
    joined = joined.withColumn("with_poldec", F.col("dedupe") * F.when(has_referral, F.col("ref_rows")).otherwise(1))
    joined = joined.withColumn("non_derived", F.col("dedupe") * F.when(has_referral, F.col("ref_ok_rows")).otherwise(1))
    joined = joined.withColumn("notfrap", alive(F.col("abuser").isNull(), F.col("non_derived")))
    return joined.withColumn("notff", alive(not_friendly_fraud(rules), F.col("notfrap")))


def funnel_cells(tables: FunnelTables, rules: FunnelRules, days: Column) -> DataFrame:
    """Stage sums per (trans_dt, first_id_dt).

    The maturity rule is the only one that depends on the window, and it looks at
    first_id_dt alone. From these cells (at most days x days rows) the funnel of any
    number of windows follows without another scan.
    """
    return weighted_rows(tables, rules, days).groupBy("trans_dt", "first_id_dt").agg(
        *[F.sum(stage).alias(stage) for stage in STAGES]
    )


def counts_from_cells(cells: DataFrame, windows: DataFrame, rules: FunnelRules, by: Sequence[str]) -> DataFrame:
    """Stage counts of each window (columns ``by``, start_date, end_date), zeros included."""
    days = days_of(windows, "start_date", "end_date", [*by, "end_date"])
    in_window = cells.join(days, "trans_dt").where(
        maturity_rule("first_id_dt", F.col("end_date"), rules.maturity_days)
    )
    sums = in_window.groupBy(*by).agg(*[F.sum(stage).alias(stage) for stage in STAGES])
    every = windows.select(*by).distinct().join(sums, list(by), "left")
    items = F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.lit(order).alias("stage_order"),
                F.coalesce(F.col(stage), F.lit(0)).cast("bigint").alias("row_count"),
            )
            for order, stage in enumerate(STAGES, start=1)
        ]
    )
    return every.select(*by, F.inline(items))


def stage_counts(
    tables: FunnelTables, windows: dict[str, tuple[str, str]], rules: FunnelRules = FunnelRules()
) -> DataFrame:
    """Funnel of each named window (``period``) from one scan of the inputs."""
    spark = tables.authorizations.sparkSession
    days = reduce(
        Column.__or__, [F.col("trans_dt").between(as_date(s), as_date(e)) for s, e in windows.values()]
    )
    rows = [
        F.struct(F.lit(name).alias("period"), as_date(s).alias("start_date"), as_date(e).alias("end_date"))
        for name, (s, e) in windows.items()
    ]
    frame = spark.range(1).select(F.inline(F.array(*rows)))
    return counts_from_cells(funnel_cells(tables, rules, days), frame, rules, ["period"])
