from __future__ import annotations

import math
import random

import pytest
from conftest import plan
from pyspark.sql import functions as F

from funnelwright.operators.ordered import running_totals
from funnelwright.operators.scorecard import feature_shift, month_summary, score_metrics


def brute(rows, threshold):
    scored = [(s, y) for s, y in rows if s is not None and not math.isnan(s)]
    known = [(s, y) for s, y in scored if y in (0, 1)]
    pos, neg = [s for s, y in known if y == 1], [s for s, y in known if y == 0]
    flagged = [y for s, y in known if s >= threshold]
    out = {"coverage": len(scored) / len(rows), "hitrate": sum(flagged) / len(flagged) if flagged else None}
    out["accuracy"] = sum((s >= threshold) == (y == 1) for s, y in known) / len(known) if known else None
    out["gini"] = out["ks"] = None
    if pos and neg:
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        out["gini"] = 2 * wins / (len(pos) * len(neg)) - 1
        share = lambda side, s: sum(x <= s for x in side) / len(side)
        out["ks"] = max(abs(share(pos, s) - share(neg, s)) for s in {*pos, *neg})
    return out


def test_metrics_are_those_of_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(900):
        label = draw.choice([0, 0, 1, None, 7])
        score = draw.choice([None, float("nan"), *[round(draw.gauss(0.3 + 0.2 * (label == 1), 0.2), 1 + i % 2) for _ in range(8)]])
        rows.append((score, label, draw.choice(["hot"] * 8 + ["a", "b", None])))
    rows += [(0.5, 1, "one class"), (None, 0, "no score")]
    df = spark.createDataFrame(rows, "score double, label int, seg string").repartition(7)
    got = {(r.segment_by, r.segment): r for r in score_metrics(df, F.col("score"), F.col("label"), 0.4, {"seg": F.col("seg")}).collect()}
    assert len(got) == 1 + 6
    for (by, segment), row in got.items():
        own = [(s, y) for s, y, seg in rows if by == "all" or seg == segment]
        assert row.n_rows == len(own)
        for name, value in brute(own, 0.4).items():
            assert row[name] == (pytest.approx(value) if value is not None else None), (segment, name)


def test_no_rows(spark):
    df = spark.createDataFrame([], "score double, label int, seg string")
    assert score_metrics(df, F.col("score"), F.col("label"), 0.5, {"seg": F.col("seg")}).count() == 0


def test_running_totals_over_many_ranges(spark):
    draw = random.Random(5)
    rows = {(draw.choice(["hot", "hot", "x", None]), draw.randint(-500, 500)): (draw.randint(0, 9), draw.randint(0, 3)) for _ in range(1500)}
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "g string, v int, a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running_totals(df, ["g"], "v", ["a", "b"])
        got = {(r.g, r.v): (r.before_a, r.before_b, r.all_a, r.all_b) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g, v in rows:
        own = [(x, n) for (h, x), n in rows.items() if h == g]
        want = [sum(n[i] for x, n in own if x < v) for i in (0, 1)] + [sum(n[i] for _, n in own) for i in (0, 1)]
        assert got[g, v] == tuple(want)
    # Every window is within a group and a range, but for the one over a group's ranges.
    windows = [line for line in plan(found).splitlines() if "windowspecdefinition" in line]
    assert windows and all("range_" in line for line in windows if " before" in line)


def brute_shift(now, then):
    share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    cuts = [min(x for x in then if 10 * sum(y <= x for y in then) >= k * len(then)) for k in range(1, 10)]
    bins = lambda xs: [sum(sum(c < x for c in cuts) == i for x in xs) / len(xs) for i in range(10)]
    psi = sum((max(a, 1e-4) - max(b, 1e-4)) * math.log(max(a, 1e-4) / max(b, 1e-4)) for a, b in zip(bins(now), bins(then)))
    return max(abs(share(now, v) - share(then, v)) for v in {*now, *then}), psi


def test_shift_is_that_of_brute_force(spark):
    draw = random.Random(8)
    rows = [(m, round(draw.gauss(10 + 2 * (m == "b"), 3), 1), draw.choice([None, 1.0, 2.0]), None) for m in "abc" for _ in range(400)]
    df = spark.createDataFrame(rows, "month string, x double, y double, z double")
    parts = [df.where(F.rand(1) < 0.5), df.where(F.rand(1) >= 0.5)]
    features = {c: F.col(c) for c in "xyz"}
    # Summaries of two halves add up to that of the whole.
    merged = month_summary(parts[0], F.col("month"), features).union(month_summary(parts[1], F.col("month"), features))
    got = {r.feature: r for r in feature_shift(merged, "b", "a").collect()}
    x = {m: [v for n, v, _, _ in rows if n == m] for m in "ab"}
    ks, psi = brute_shift(x["b"], x["a"])
    assert got["x"].ks == pytest.approx(ks) and got["x"].psi == pytest.approx(psi) and psi > 0.1
    assert got["x"].mean_current == pytest.approx(sum(x["b"]) / 400) and got["x"].p50_baseline == sorted(x["a"])[199]
    assert got["y"].null_share_current == pytest.approx(sum(m == "b" and y is None for m, _, y, _ in rows) / 400)
    assert (got["z"].ks, got["z"].psi, got["z"].p10_current, got["z"].null_share_baseline) == (None, None, None, 1.0)
    steps = month_summary(df, F.col("month"), {"x": F.col("x")}, {"x": 5})
    assert {r.value for r in steps.collect()} <= {float(v) for v in range(-10, 40, 5)}
    assert feature_shift(month_summary(df.limit(0), F.col("month"), features), "b", "a").count() == 0
