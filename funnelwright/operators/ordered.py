"""Running totals over an order that no single task has to see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelwright.sources.tables import cut_lineage


def running_totals(counted: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """``counted`` with ``before_<c>`` and ``all_<c>`` for every column of ``sums``.

    ``counted`` has one row for each (by..., value), ``by`` at least one column, null being a group.
    ``before_<c>`` is the sum over smaller values of the group, ``all_<c>`` that over all of them.

    Rows are dealt by ranges of (by..., value), so a group with most of the rows lies in many
    ranges. A window adds up within a range; what earlier ranges hold comes from one row for each
    group and range.
    """
    part = "range_"
    placed = cut_lineage(counted.repartitionByRange(*by, value).withColumn(part, F.spark_partition_id()))
    ranges = placed.groupBy(*by, part).agg(*[F.sum(c).alias(f"sum_{c}") for c in sums])
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(
        *[F.col(c).alias(f"{c}_") for c in (*by, part)],
        *[F.coalesce(F.sum(f"sum_{c}").over(earlier), F.lit(0)).alias(f"carried_{c}") for c in sums],
        *[F.sum(f"sum_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    added = placed.withColumns({f"own_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    same = [added[c].eqNullSafe(carried[f"{c}_"]) for c in (*by, part)]
    met = added.join(carried, same)
    return met.select(
        *counted.columns,
        *[(F.col(f"own_{c}") + F.col(f"carried_{c}")).alias(f"before_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )
