from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import plan
from pyspark.sql import functions as F

from funnelwright.operators.drivers import dimension_column, driver_package, segment_counts, top_per_dimension, top_segments
from funnelwright.operators.funnel import STAGES, FunnelRules, FunnelTables, count_frames, stage_counts, stage_frames
from funnelwright.operators.sampling import join_labels, key_uniform, label_preserving_sample, sample_rule
from funnelwright.sources.tables import cut_lineage

DAYS = [dt.date(2024, 1, d) for d in range(1, 11)]


def random_tables(spark, seed: int) -> FunnelTables:
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(300)]
    day_of = {k: rng.choice(DAYS) for k in keys}

    def maybe(value, share=0.1):
        return None if rng.random() < share else value

    auth = [
        (k, "a", maybe(f"c{rng.randint(0, 20)}"), maybe(rng.choice("01569")), day_of[k], maybe(rng.choice([20.0, 50.0, 90.0])),
         maybe(rng.choice(["false", "false", "true"])), rng.choice("1110"), "m", "US")
        for k in keys
    ]
    labels = [
        (k, day_of[k], maybe(rng.randint(0, 1), 0.2), "m1", maybe(rng.choice(["1.a", "3.b", "2.c"])),
         maybe(day_of[k] + dt.timedelta(days=rng.randint(0, 40))))
        for k in rng.sample(keys, 220)
    ]
    labels += labels[:15]
    analytics = [(k, day_of[k], maybe(rng.choice(["0", "00", "1", "x"]))) for k in keys * 2 if rng.random() < 0.6]
    referrals = [(rng.choice(keys), maybe(rng.choice(["01", "18", "77", "99"]))) for _ in range(300)]
    return FunnelTables(
        spark.createDataFrame(
            auth,
            "cas_pkey string, cm15 string, cm13 string, appr_deny_cd string, trans_dt date, amount double, "
            "cancl_plastic_cd string, arm_proc_ind string, cm11 string, country_cd string",
        ),
        spark.createDataFrame(
            labels, "cas_pkey string, trans_dt date, lift_frd_in int, modl_id string, lift_path_ds string, first_id_dt date"
        ),
        spark.createDataFrame(analytics, "cas_pkey string, trans_dt date, zero_value_auth_ind string"),
        spark.createDataFrame([(rng.choice(keys),) for _ in range(40)], "cas_pkey string"),
        spark.createDataFrame(referrals, "cas_pkey string, referral_rsn_cd string"),
        spark.createDataFrame([(maybe(f"c{i}"), i % 2) for i in list(range(8)) * 2], "cm13 string, frap_in int"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_counts_equal_the_chain(spark, seed):
    tables, rules = random_tables(spark, seed), FunnelRules(sample_rate=0.6)
    windows = {"now": ("2024-01-06", "2024-01-10"), "before": ("2024-01-01", "2024-01-06"), "none": ("2025-01-01", "2025-01-02")}
    fused = {(r.period, r.stage): r.row_count for r in stage_counts(tables, windows, rules).collect()}
    assert len(fused) == 30
    for name, (start, end) in windows.items():
        chain = {r.stage: r.row_count for r in count_frames(stage_frames(tables, start, end, rules)).collect()}
        assert chain == {stage: n for (period, stage), n in fused.items() if period == name}
    assert fused["now", "with_poldec"] > fused["now", "dedupe"] > fused["now", "notff"] > 0


def test_funnel_plans(spark):
    tables = random_tables(spark, 1)
    frames = stage_frames(tables, "2024-01-01", "2024-01-10")
    assert "LeftAnti" in plan(frames["notff"])
    fused = plan(stage_counts(tables, {"w": ("2024-01-01", "2024-01-10")}))
    for text in ("BatchEvalPython", "CartesianProduct", "Window"):
        assert text not in fused


def test_friendly_fraud_rule_with_unknowns(spark):
    from funnelwright.operators.funnel import not_friendly_fraud

    rows = [(1, "1.x", 50.0), (1, "1.x", 50.1), (1, None, 20.0), (1, "1.x", None), (1, "2.x", None), (0, None, None), (1, None, 99.0)]
    df = spark.createDataFrame(rows, "lift_frd_in int, lift_path_ds string, amount double")
    kept = {tuple(r) for r in df.where(not_friendly_fraud(FunnelRules())).collect()}
    assert kept == {rows[1], rows[4], rows[5], rows[6]}


def test_sample_equals_join_then_filter(spark):
    tables = random_tables(spark, 3)
    auth, labels = tables.authorizations.select("cas_pkey", "trans_dt"), tables.labels
    on = ["cas_pkey", "trans_dt"]
    plain = join_labels(auth, labels, on, "lift_frd_in").where(sample_rule("lift_frd_in", key_uniform("cas_pkey"), 0.3))
    fast = label_preserving_sample(auth, labels, "cas_pkey", on, "lift_frd_in", 0.3)
    assert sorted(map(repr, fast.collect())) == sorted(map(repr, plain.select(fast.columns).collect()))
    kept = {r.cas_pkey for r in fast.collect()}
    assert {r.cas_pkey for r in labels.where("lift_frd_in = 1").collect()} <= kept
    draws = [r[0] for r in spark.range(20000).select(key_uniform("id")).collect()]
    assert all(0 <= u < 1 for u in draws) and abs(sum(u >= 0.975 for u in draws) / 20000 - 0.025) < 0.005


def test_top_segments_and_package(spark):
    rows = [(i % 40, "x" if i % 3 else None, 1.0) for i in range(400)] + [(7, "x", 5.0)] * 3
    df = spark.createDataFrame(rows, "cm11 int, country_cd string, amount double")
    top = top_segments(df, "mcc").collect()
    assert len(top) == 25 and (top[0].segment_value, top[0].cnt, top[0].total_amt) == (7, 13, 25.0)
    assert [r.segment_value for r in top[1:5]] == [0, 1, 2, 3]
    assert [r.segment_value for r in top_segments(df, "country").collect()] == ["x", None]
    with pytest.raises(ValueError):
        dimension_column(df, "nowhere")
    counts = segment_counts(df.withColumn("id", F.lit(1)), {"mcc": F.col("cm11"), "country": F.col("country_cd")}, F.col("amount"), ["id"])
    ranked = top_per_dimension(counts, ["id"])
    assert plan(ranked).count("WindowGroupLimit") == 2
    package = driver_package(ranked, ["id"]).first().top_drivers
    assert len(package.mcc) == 25 and package.mcc[0].cnt == 13 and package.country[1].segment_value is None
    assert package.cm15 == []


def test_frames_are_staged_after_each_join(spark):
    rows = spark.createDataFrame(
        [(i, 1, 1, "1", "2024-01-02", 5.0, "false", "1", "x", "us") for i in range(3)],
        "cas_pkey int, cm15 int, cm13 int, appr_deny_cd string, trans_dt string, amount double, cancl_plastic_cd string, arm_proc_ind string, cm11 string, country_cd string",
    ).withColumn("trans_dt", F.col("trans_dt").cast("date"))
    tables = FunnelTables(
        authorizations=rows,
        labels=rows.select("cas_pkey", "trans_dt", F.lit(1).alias("lift_frd_in"), F.lit("m").alias("modl_id"), F.lit("p").alias("lift_path_ds"), F.col("trans_dt").alias("first_id_dt")),
        analytics=rows.select("cas_pkey", "trans_dt", F.lit("0").alias("zero_value_auth_ind")),
        credit_flags=rows.where("cas_pkey = 0").select("cas_pkey"),
        referrals=rows.select("cas_pkey", F.lit("99").alias("referral_rsn_cd")),
        first_party=rows.select("cm13", F.lit(0).alias("frap_in")),
    )
    window = ("2024-01-01", "2024-01-31", FunnelRules())
    plain = count_frames(stage_frames(tables, *window))
    staged = count_frames(stage_frames(tables, *window, cut_lineage))
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, plain.collect()))
    assert [r.stage for r in staged.orderBy("stage_order").collect()] == STAGES
    assert "Join" not in plan(staged)
