"""Fixed-length sequences as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQUENCE_LENGTH = 10
# Fixed values of the day-gap rule: filler age and the largest gap that is kept.
MISSING_AGE = 1000
MAX_GAP_DAYS = 30


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pad_left(values: Column, length: int = SEQUENCE_LENGTH, keep: str = "oldest") -> Column:
    """Zeros in front up to ``length``; longer lists keep the oldest (default) or latest items."""
    if keep not in ("oldest", "latest"):
        raise ValueError("keep must be 'oldest' or 'latest'")

    def padded(v: Column) -> Column:
        filled = F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(v), F.lit(0))), v)
        return F.slice(filled, 1 if keep == "oldest" else -length, length)

    return _bind(values.cast("array<int>"), padded)


def _latest(values: Column, filler: int, length: int) -> Column:
    return F.slice(F.concat(F.array_repeat(F.lit(filler), length), values.cast("array<int>")), -length, length)


def gap_sequence(ages: Column, hours: Column, length: int = SEQUENCE_LENGTH, max_gap: int = MAX_GAP_DAYS) -> Column:
    """Latest ``length`` day gaps to the last item, plus the hour code.

    The gap is age - last age + 1. Items older than the first one within ``max_gap`` days
    become 0, hour included. An empty age list gives zeros.
    """

    def build(x: Column) -> Column:
        gaps = F.transform(x, lambda a: a - F.element_at(x, -1) + 1)
        return _bind(F.struct(gaps.alias("d"), _latest(hours, 0, length).alias("h")), combine)

    def combine(s: Column) -> Column:
        within = F.transform(s["d"], lambda d, i: F.when(d <= max_gap, i))
        return _bind(
            F.struct(s["d"].alias("d"), s["h"].alias("h"), F.coalesce(F.array_min(within), F.lit(length)).alias("cut")),
            lambda t: F.transform(t["d"], lambda d, i: F.when(i < t["cut"], 0).otherwise(d + F.get(t["h"], i))),
        )

    zeros = F.array_repeat(F.lit(0), length)
    return F.when(F.size(ages) > 0, _bind(_latest(ages, MISSING_AGE, length), build)).otherwise(zeros)


def expand(values: Column | str, name: str, length: int = SEQUENCE_LENGTH) -> list[Column]:
    """``name_1 .. name_n`` integer columns of an array; missing positions are null."""
    values = F.col(values) if isinstance(values, str) else values
    return [F.get(values, F.lit(i)).cast("int").alias(f"{name}_{i + 1}") for i in range(length)]
