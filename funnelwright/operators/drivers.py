"""Top segments of a metric per dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_SEGMENTS = 25
# Dimension names and their columns; any other name is a column itself.
DIMENSION_COLUMNS = {"mcc": "cm11", "country": "country_cd", "model_id": "modl_id", "lift_path": "lift_path_ds"}
# The dimensions analysed by default, and all keys of a driver package.
DEFAULT_DIMENSIONS = ["mcc", "country", "model_id", "lift_path"]
PACKAGE_KEYS = [
    "mcc", "country", "model_id", "lift_path", "approval_code", "cm15", "canceled_plastic", "zero_value_auth",
]


def dimension_column(df: DataFrame, dimension: str) -> Column:
    """Column of a named dimension; an unknown column is an error here, not at run time."""
    name = DIMENSION_COLUMNS.get(dimension, dimension)
    if name not in df.columns:
        raise ValueError(f"dimension {dimension!r} has no column {name!r}")
    return F.col(name)


def top_segments(df: DataFrame, dimension: str, amount: str = "amount", top: int | None = TOP_SEGMENTS) -> DataFrame:
    """Segments of one dimension by row count; null is a segment, ties go by segment value."""
    grouped = (
        df.groupBy(dimension_column(df, dimension).alias("segment_value"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum(amount).alias("total_amt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_first("segment_value"))
    )
    return grouped if top is None else grouped.limit(top)


def segment_counts(
    df: DataFrame, dimensions: Mapping[str, Column], amount: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Count and amount per (by..., dimension, segment) for several dimensions in one scan.

    Each row is unfolded into one small row per dimension; the partial aggregation in the
    same stage folds them again before anything is shuffled.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), column.cast("string").alias("segment_value"))
            for name, column in dimensions.items()
        ]
    )
    unfolded = df.select(*by, amount.alias("amount"), F.inline(pairs))
    return unfolded.groupBy(*by, "dimension", "segment_value").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("amount").alias("total_amt")
    )


def top_per_dimension(counts: DataFrame, by: Sequence[str] = (), top: int = TOP_SEGMENTS) -> DataFrame:
    """Best ``top`` segments per (by..., dimension), with their rank.

    Spark limits each group before the shuffle as well (a rank filter on a window), so a
    dimension with very many segments does not gather in one task.
    """
    window = Window.partitionBy(*by, "dimension").orderBy(F.desc("cnt"), F.asc_nulls_first("segment_value"))
    return counts.withColumn("segment_rank", F.row_number().over(window)).where(F.col("segment_rank") <= top)


#: What a segment of a package says.
SEGMENT_FIELDS = ("segment_rank", "segment_value", "cnt", "total_amt")
CHANGE_FIELDS = ("segment_rank", "segment_value", "current", "baseline", "change", "size_effect", "mix_effect")


def driver_package(
    segments: DataFrame, by: Sequence[str], fields: Sequence[str] = SEGMENT_FIELDS, name: str = "top_drivers"
) -> DataFrame:
    """One array of segment structs per package key and ``by`` group; a key without rows is empty.

    Takes the output of ``top_per_dimension``, so a group holds at most ``top`` rows per key.
    """
    item = F.struct(*fields)
    arrays = [
        F.array_sort(F.collect_list(F.when(F.col("dimension") == key, item))).alias(key) for key in PACKAGE_KEYS
    ]
    return segments.groupBy(*by).agg(*arrays).select(*by, F.struct(*PACKAGE_KEYS).alias(name))


def segment_changes(counts: DataFrame, pairs: DataFrame, top: int = TOP_SEGMENTS, totals: DataFrame | None = None) -> DataFrame:
    """Segments whose rows a day changed most from a baseline window to the current one, per pair and dimension.

    ``counts``: window_id, dimension, segment_value, cnt; a segment of a window can come in parts. ``pairs``:
    pair_id, role (current, baseline), window_id and its number of ``days``. ``totals``: window_id, dimension, cnt
    of all segments together, where that is known already. A segment missing in one window has 0 there. The change is
    split into two parts that add up to it: ``size_effect`` is what the segment would have changed at
    its old share of all rows, ``mix_effect`` what comes from the change of its share.

    Counts that lie together by dimension and segment stay where they are: the change does not depend on the
    totals, so only the segments shown leave their task.
    """

    def rows_a_day(role: str) -> Column:
        return F.sum(F.when(F.col("role") == role, F.col("cnt")).otherwise(0)) / F.max(F.when(F.col("role") == role, F.col("days")))

    def both(rows: DataFrame, *by: str, suffix: str = "") -> DataFrame:
        sums = [F.coalesce(rows_a_day(r), F.lit(0.0)).alias(r + suffix) for r in ("current", "baseline")]
        return rows.join(pairs, "window_id").groupBy("pair_id", "dimension", *by).agg(*sums)

    compared = both(counts, "segment_value").withColumn("change", F.col("current") - F.col("baseline"))
    window = Window.partitionBy("pair_id", "dimension").orderBy(F.desc(F.abs("change")), F.asc_nulls_first("segment_value"))
    most = compared.withColumn("segment_rank", F.row_number().over(window)).where(F.col("segment_rank") <= top)
    share = F.coalesce(F.try_divide("baseline", "baseline_all"), F.lit(0.0))
    split = most.join(both(counts if totals is None else totals, suffix="_all"), ["pair_id", "dimension"])
    split = split.withColumn("size_effect", share * (F.col("current_all") - F.col("baseline_all")))
    return split.withColumn("mix_effect", F.col("change") - F.col("size_effect"))
