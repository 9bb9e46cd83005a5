"""Label join and label-preserving sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.functions.measures import as_date

DEFAULT_SAMPLE_RATE = 0.025
MATURITY_DAYS = 21


def key_uniform(key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key alone, so every recomputation draws the same sample."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def join_labels(df: DataFrame, labels: DataFrame, on: list[str], label: str) -> DataFrame:
    """Left join of the labels on (key, date); rows without one get label 0."""
    return df.join(labels, on, "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)))


def sample_rule(label: Column | str, u: Column, rate: float) -> Column:
    """Keeps every labelled row and about ``rate`` of the others."""
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(label, F.lit(0)) + u >= F.lit(1.0 - rate)


def maturity_rule(first_seen: Column | str, end: Column, days: int = MATURITY_DAYS) -> Column:
    """Label seen within ``days`` after the window end, or no label date."""
    first_seen = F.col(first_seen) if isinstance(first_seen, str) else first_seen
    return first_seen.isNull() | (first_seen <= F.date_add(as_date(end), days))


def label_preserving_sample(
    df: DataFrame,
    labels: DataFrame,
    key: str,
    on: list[str],
    label: str,
    rate: float = DEFAULT_SAMPLE_RATE,
    u: Column | None = None,
) -> DataFrame:
    """``df`` left-joined to its labels, then sampled.

    A plain left join would shuffle every row only to drop most of them. A row whose own
    draw is too low survives only through a positive label, so it takes an inner join with
    the few positive labels (which Spark broadcasts, or turns into a runtime filter on the
    scan); only the ``rate`` share that survives anyway meets the whole label table. The
    two parts are disjoint and together give exactly the rows of join-then-filter. ``u``
    must not change between the two reads: use ``key_uniform`` (default), not ``rand()``.
    """
    u = key_uniform(key) if u is None else u
    drawn = join_labels(df.where(u >= F.lit(1.0 - rate)), labels, on, label).where(sample_rule(label, u, rate))
    positive = labels.where(F.col(label) > 0)
    rescued = df.where(u < F.lit(1.0 - rate)).join(positive, on, "inner").where(sample_rule(label, u, rate))
    return drawn.unionByName(rescued.withColumn(label, F.coalesce(F.col(label), F.lit(0))))


def drawn_keys_only(side: DataFrame, labels: DataFrame, key: str, label: str, rate: float) -> DataFrame:
    """Rows of a side table whose key can be in ``label_preserving_sample`` at this rate.

    Those are the keys with a high enough draw (a scan filter) and the positively labelled
    ones (a semi join with few keys), so the rest is dropped before it is shuffled.
    """
    if rate >= 1:
        return side
    u = key_uniform(key)
    positive = labels.where(F.col(label) > 0).select(key)
    drawn, low = side.where(u >= F.lit(1.0 - rate)), side.where(u < F.lit(1.0 - rate))
    return drawn.unionByName(low.join(positive, key, "left_semi"))
