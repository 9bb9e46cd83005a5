"""Metrics of a scored table, and the shift of features between months."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.operators.ordered import running_totals

# The metrics of a scored table.
DEFAULT_METRICS = ["coverage", "hitrate", "accuracy", "gini", "ks"]
ALL = "all"
#: Bins of the stability index; the least share that a bin counts with.
BINS, LEAST_SHARE = 10, 0.0001


def _counted(rows: DataFrame, score: Column, label: Column, segments: Mapping[str, Column]) -> DataFrame:
    """(segment_by, segment, score, n, positive, negative): equal scores of a segment as one row."""
    plain = score.cast("double")
    inputs = rows.select(
        F.when(~F.isnan(plain), plain).alias("score"),
        label.cast("int").alias("label"),
        F.inline(
            F.array(
                F.struct(F.lit(ALL).alias("segment_by"), F.lit(ALL).alias("segment")),
                *[F.struct(F.lit(n).alias("segment_by"), c.cast("string").alias("segment")) for n, c in segments.items()],
            )
        ),
    )
    return inputs.groupBy("segment_by", "segment", "score").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
    )


def score_metrics(
    rows: DataFrame, score: Column, label: Column, threshold: float, segments: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row for the whole table and one for each segment: segment_by, segment, n_rows and the metrics.

    * coverage: share of the rows that have a score (null and NaN are none)
    * hitrate: share of positives among labelled rows scored at the threshold or above
    * accuracy: share of labelled and scored rows on the right side of the threshold
    * ks: largest distance between the two classes' cumulative shares, over all scores
    * gini: twice the area under the curve less one, tied scores counting half

    Labels are 1 and 0, others count as unlabelled; a metric without rows (ks and gini: without both
    classes) is null. The order of the scores comes from ``running_totals``: no window holds a segment.
    """
    by = ["segment_by", "segment"]
    counted = _counted(rows, score, label, segments or {})
    flagged, labelled = F.col("score") >= threshold, F.col("positive") + F.col("negative")
    right = F.when(flagged, F.col("positive")).otherwise(F.col("negative"))
    scored = F.col("score").isNotNull()
    plain = counted.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        (F.sum(F.when(scored, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
        F.try_divide(F.sum(F.when(flagged, F.col("positive"))), F.sum(F.when(flagged, labelled))).alias("hitrate"),
        F.try_divide(F.sum(F.when(scored, right)), F.sum(F.when(scored, labelled))).alias("accuracy"),
    )
    ranked = running_totals(
        counted.where(scored & (labelled > 0)).select(*by, "score", "positive", "negative"), by, "score", ["positive", "negative"]
    )
    share = {c: F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(f"all_{c}")) for c in ("positive", "negative")}
    # Twice the pairs that the score puts in the right order; whole numbers, so no order of summing matters.
    twice = F.col("positive").cast("decimal(19,0)") * (2 * F.col("before_negative") + F.col("negative")).cast("decimal(19,0)")
    pairs = F.max("all_positive").cast("double") * F.max("all_negative").cast("double")
    order = ranked.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(
        F.max(F.abs(share["positive"] - share["negative"])).alias("ks"),
        (F.try_divide(F.sum(twice).cast("double"), pairs) - 1).alias("gini"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]
    return plain.join(order, same, "left").select(*by, "n_rows", *DEFAULT_METRICS)


def month_summary(rows: DataFrame, month: Column, features: Mapping[str, Column], step: Mapping[str, float] | None = None) -> DataFrame:
    """(feature, month, value, n): how often each value of a feature occurs in a month; null is a value.

    Summaries add up: those of several inputs are merged by a union and a sum of ``n``. A feature with a
    ``step`` is kept as the multiple of it below the value, which bounds the summary's size whatever
    the number of rows. NaN counts as null.
    """
    step = step or {}
    named = []
    for name, column in features.items():
        value = column.cast("double")
        value = F.when(~F.isnan(value), value)
        value = F.floor(value / step[name]) * F.lit(float(step[name])) if name in step else value
        named.append(F.struct(F.lit(name).alias("feature"), value.alias("value")))
    long = rows.select(month.alias("month"), F.inline(F.array(*named)))
    return long.groupBy("feature", "month", "value").agg(F.count(F.lit(1)).alias("n"))


def feature_shift(summary: DataFrame, current: Column | str, baseline: Column | str) -> DataFrame:
    """One row for each feature: how its values moved from the baseline month to the current one.

    feature, n_current, n_baseline, null_share_*, mean_*, p10_*, p50_*, p90_* (smallest value that this
    share of the values doesn't pass), ``ks`` (largest distance of the cumulative shares) and ``psi``, the
    stability index over ten bins cut at the baseline's tenths (a share counts as LEAST_SHARE at least).
    What a month without values can't give is null.
    """
    current, baseline = (F.lit(m) if isinstance(m, str) else m for m in (current, baseline))
    is_current, is_baseline = F.col("month") == current, F.col("month") == baseline
    both = summary.where(is_current | is_baseline).groupBy("feature", "value").agg(
        F.sum(F.when(is_current, F.col("n")).otherwise(0)).alias("current"),
        F.sum(F.when(is_baseline, F.col("n")).otherwise(0)).alias("baseline"),
    )
    sides = ("current", "baseline")
    present = F.col("value").isNotNull()
    plain = both.groupBy("feature").agg(
        *[F.sum(s).alias(f"n_{s}") for s in sides],
        *[F.try_divide(F.sum(F.when(~present, F.col(s)).otherwise(0)), F.sum(s)).alias(f"null_share_{s}") for s in sides],
        *[F.try_divide(F.sum(F.col("value") * F.col(s)), F.sum(F.when(present, F.col(s)))).alias(f"mean_{s}") for s in sides],
    )
    ranked = running_totals(both.where(present), ["feature"], "value", list(sides))
    upto = {s: F.col(f"before_{s}") + F.col(s) for s in sides}
    tenths = [
        F.min(F.when((F.col(s) > 0) & (10 * upto[s] >= k * F.col(f"all_{s}")), F.col("value"))).alias(f"p{k}0_{s}")
        for k in (1, 5, 9)
        for s in sides
    ]
    far = F.abs(F.try_divide(upto["current"], F.col("all_current")) - F.try_divide(upto["baseline"], F.col("all_baseline")))
    # A value's bin is the number of the baseline's tenths below it.
    bin_ = F.least(F.floor(F.try_divide(BINS * F.col("before_baseline"), F.col("all_baseline"))), F.lit(BINS - 1))
    order = ranked.groupBy("feature").agg(*tenths, F.max(far).alias("ks"))
    bins = ranked.groupBy("feature", bin_.alias("bin")).agg(
        *[F.sum(s).alias(s) for s in sides], *[F.max(f"all_{s}").alias(f"all_{s}") for s in sides]
    )
    share = {s: F.greatest(F.col(s) / F.nullif(F.col(f"all_{s}"), F.lit(0)), F.lit(LEAST_SHARE)) for s in sides}
    known = (F.col("all_current") > 0) & (F.col("all_baseline") > 0)
    # Bins that neither month reaches don't come up; at equal shares they would add nothing.
    psi = F.sum(F.when(known, (share["current"] - share["baseline"]) * F.ln(share["current"] / share["baseline"])))
    index = bins.groupBy("feature").agg(psi.alias("psi"))
    return plain.join(order, "feature", "left").join(index, "feature", "left")
