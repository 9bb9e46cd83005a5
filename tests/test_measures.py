from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from funnelwright.functions.arrays import expand, gap_sequence, pad_left
from funnelwright.functions.measures import age_in_days, lookback_dates, pct_change, percent_text, safe_double


def test_percent_text_rounds_like_the_exact_value(spark):
    rng = random.Random(3)
    values = [0.10125, -0.10125, 0.2675, 1.00375, -0.5, 12.345675, 0.125, 0.999999]
    values += [rng.choice([-1, 1]) * rng.randint(101, 99999) / rng.choice([800, 1000, 3200, 777, 100000]) for _ in range(400)]
    values = [v for v in values if abs(v) > 0.1]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", percent_text(F.col("x")).alias("t"))
    assert [(r.x, r.t) for r in df.collect()] == [(v, f"{v:.2%}") for v in values]


def test_pct_change_and_safe_double(spark):
    rows = [("1.5", "3"), ("2", "0"), ("x", "1"), (None, "1"), ("1", None), ("", "2")]
    df = spark.createDataFrame(rows, "v string, b string")
    got = [r[0] for r in df.select(pct_change(safe_double("v"), safe_double("b"))).collect()]
    assert got == [-0.5, None, None, None, None, None]


def test_dates(spark):
    assert lookback_dates("2024-01-31") == {"start_dt_10": dt.date(2024, 1, 21), "start_dt_20": dt.date(2024, 1, 1)}
    df = spark.createDataFrame([(dt.date(2020, 12, 30),), (dt.date(2021, 1, 5),)], "d date")
    assert [r[0] for r in df.select(age_in_days("d")).collect()] == [2, -4]


def padded_rule(values, keep):
    filled = [0] * (10 - len(values)) + values
    return filled[:10] if keep == "oldest" else filled[-10:]


def gap_rule(ages, hours):
    if not ages:
        return [0] * 10
    x, h = ([1000] * 10 + ages)[-10:], ([0] * 10 + hours)[-10:]
    gaps = [a - x[-1] + 1 for a in x]
    first = next(i for i, g in enumerate(gaps) if g <= 30)
    return [0 if i < first else g + h[i] for i, g in enumerate(gaps)]


def test_sequences_of_random_lists(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        n = rng.randint(0, 14)
        ages = sorted((rng.choice([rng.randint(0, 60), rng.randint(0, 1100)]) for _ in range(n)), reverse=rng.random() < 0.8)
        rows.append((i, ages, [rng.randint(0, 3) for _ in range(rng.choice([n, max(n - 1, 0)]))]))
    rows += [(900, [31, 1], [1, 2]), (901, [30, 1], [1, 2]), (902, [971], [1]), (903, [980, 975], [1, 1])]
    df = spark.createDataFrame(rows, "i int, a array<int>, h array<int>")
    got = df.select(
        "i",
        pad_left(F.col("a")).alias("old"),
        pad_left(F.col("a"), keep="latest").alias("new"),
        gap_sequence(F.col("a"), F.col("h")).alias("gap"),
    ).collect()
    for (i, a, h), row in zip(sorted(rows), sorted(got)):
        assert row.old == padded_rule(a, "oldest"), i
        assert row.new == padded_rule(a, "latest"), i
        assert row.gap == gap_rule(a, h), i


def test_expand_missing_positions_are_null(spark):
    row = spark.range(1).select(*expand(F.array(F.lit(5), F.lit(6)), "c", 3)).first()
    assert (row.c_1, row.c_2, row.c_3) == (5, 6, None)
