"""Fixed-length feature sequences per transaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelwright.functions.arrays import SEQUENCE_LENGTH, expand, gap_sequence, pad_left

# The bucketed features in sequence order; "ngttime" combines the age and the hour code.
OUTPUT_ORDER = [
    "aav", "disruption", "email", "ftg", "indusamt", "ip", "location", "onword", "phone", "seprn", "sepry", "stcd",
    "txn_att", "topmaps", "ngttime", "velocity", "cm_char",
]

BucketRule = Column | Sequence[tuple[Column, int]]


def bucketize(df: DataFrame, rules: Mapping[str, BucketRule], keep: Sequence[Column | str] = ()) -> DataFrame:
    """Integer code columns by rule, next to the ``keep`` columns.

    A rule is a Column or an ordered list of (condition, code); no condition met gives null.
    End a list with ``(F.lit(True), code)`` for a default.
    """
    columns = []
    for name, rule in rules.items():
        if not isinstance(rule, Column):
            (condition, code), *rest = rule
            column = F.when(condition, F.lit(code))
            for condition, code in rest:
                column = column.when(condition, F.lit(code))
            rule = column
        columns.append(rule.cast("int").alias(name))
    return df.select(*keep, *columns)


@dataclass(frozen=True)
class SequenceSpec:
    """Which columns become sequences.

    ``plain`` maps an output name to its feature column; ``gap`` to its (age, hour) columns.
    ``order`` lists the output names in output order.
    """

    plain: Mapping[str, str]
    gap: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    order: Sequence[str] = ()
    key: str = "cas_pkey"
    label: str = "lift_frd_in"
    length: int = SEQUENCE_LENGTH
    keep: str = "oldest"
    align: bool = False

    @property
    def names(self) -> list[str]:
        return list(self.order) or [*self.plain, *self.gap]

    @property
    def gap_columns(self) -> list[str]:
        return list(dict.fromkeys(c for pair in self.gap.values() for c in pair))

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.plain.values(), *self.gap_columns]))


def standard_spec(**changes: object) -> SequenceSpec:
    """The 17 sequences of the training layout."""
    plain = {name: f"{name}_buc_3b" for name in OUTPUT_ORDER if name != "ngttime"}
    values = {"plain": plain, "gap": {"ngttime": ("age_in_days", "time_buc_3b")}, "order": tuple(OUTPUT_ORDER)}
    return SequenceSpec(**{**values, **changes})


def join_history(mapping: DataFrame, features: DataFrame | None, sample: DataFrame, spec: SequenceSpec) -> DataFrame:
    """History pairs with the features of the historical row and the label of the current one.

    The sample goes first: it removes most pairs before the wide features are joined. Without ``features`` the
    mapping has them, as ``history_map`` carries them along: then a current row meets its label with
    its pairs still in one array, and they lie together by key from there on.
    """
    key, hist = spec.key, f"{spec.key}_hist"
    labels = sample.select(key, spec.label)
    if features is None:
        pairs = mapping.select(key, "seq", "pairs").join(labels, key).select(key, "seq", spec.label, F.inline("pairs"))
        joined = pairs.select(hist, key, "seq", "seq_hist", spec.label, *spec.columns)
    else:
        pairs = mapping.select(key, hist, "seq", "seq_hist").join(labels, key)
        wide = features.select(F.col(key).alias(hist), *spec.columns)
        joined = pairs.join(wide, hist)
    return joined.fillna(0, spec.columns) if spec.align else joined


def running_lists(joined: DataFrame, spec: SequenceSpec) -> DataFrame:
    """Running lists of every feature up to the current row: one row per distinct current row and label.

    A list holds the values of the key's rows with no larger ``seq_hist`` (equal ones ordered by the
    historical key), null values left out. The rows of a key are gathered once, not once for each of
    them, and only its current rows are given out: nothing is larger than the lists that are asked for.
    """
    rows = joined.groupBy(spec.key, spec.label).agg(F.array_sort(F.collect_set(_row_struct(spec, "seq"))).alias("rows"))
    current = F.explode(F.filter("rows", lambda r: r["seq_hist"] == r["seq"]))

    def values(column: str) -> Column:
        past = F.filter("rows", lambda r: r["seq_hist"] <= F.col("now.seq_hist"))
        return F.filter(F.transform(past, lambda r: r[column]), lambda v: v.isNotNull()).alias(column)

    return rows.select("*", current.alias("now")).select(
        spec.key, "now.seq", "now.seq_hist", spec.label, *[values(c) for c in spec.columns]
    )


def _row_struct(spec: SequenceSpec, *more: str) -> Column:
    return F.struct("seq_hist", f"{spec.key}_hist", *spec.columns, *more)


def _null_pattern(columns: Sequence[str]) -> Column:
    """A bit per column: which of them are null."""
    if len(columns) > 63:
        raise ValueError(f"a null pattern holds 63 columns, not {len(columns)}")
    pattern = F.lit(0).cast("bigint")
    for position, column in enumerate(columns):
        pattern = pattern.bitwiseOR(F.when(F.col(column).isNull(), F.lit(1 << position)).otherwise(0))
    return pattern


def _needed_rows(rows: DataFrame, spec: SequenceSpec) -> DataFrame:
    """The rows of each key that can appear in a sequence, marked by the end they count from.

    Among rows with the same null pattern only the first ``length`` (for oldest-first
    features) or the last ``length`` (for the latest) can be in a list of that length, so a
    rank filter within (key, pattern) loses nothing. Spark applies such a filter before the
    shuffle too: a key with a third of all rows leaves each task as a handful of rows.
    """
    plain = list(dict.fromkeys(spec.plain.values()))
    latest_only = spec.keep == "latest"
    back_columns = spec.columns if latest_only else spec.gap_columns
    order = ["seq_hist", f"{spec.key}_hist", *spec.columns]

    def ranked(columns: Sequence[str], ascending: bool) -> DataFrame:
        ordering = [F.col(c).asc_nulls_first() if ascending else F.col(c).desc_nulls_last() for c in order]
        window = Window.partitionBy(spec.key, spec.label, "null_pattern").orderBy(*ordering)
        marked = rows.withColumn("null_pattern", _null_pattern(columns))
        kept = marked.withColumn("rank_in_pattern", F.row_number().over(window))
        return kept.where(F.col("rank_in_pattern") <= spec.length).drop("rank_in_pattern", "null_pattern")

    back = ranked(back_columns, False).withColumn("from_end", F.lit(True))
    if latest_only:
        return back.withColumn("from_start", F.lit(True))
    back = back.withColumn("from_start", F.lit(False))
    front = ranked(plain, True).withColumn("from_end", F.lit(False)).withColumn("from_start", F.lit(True))
    return front.unionByName(back)


def sequence_lists(joined: DataFrame, spec: SequenceSpec, history_bound: int | None = None) -> DataFrame:
    """One row per key and label: an ordered value array per feature column.

    Equals the running lists at the current row (``seq_hist = seq``), up to the items the
    padded sequences read. Keys without their current row give no row. Ties in ``seq_hist``
    are ordered by the historical key.

    ``history_bound`` states that a key has at most that many pairs (as from
    ``history_map``); the rows of a key are then gathered directly. Without it the rows are
    first deduplicated and cut to those a sequence can read, so the group stays bounded for
    any input.
    """
    past = joined.where(F.col("seq_hist") <= F.col("seq"))
    is_current = F.col("seq_hist") == F.col("seq")
    item = _row_struct(spec)
    if history_bound is None:
        rows = past.select(spec.key, f"{spec.key}_hist", "seq", "seq_hist", spec.label, *spec.columns).distinct()
        rows = _needed_rows(rows, spec)
        front = F.collect_list(F.when(F.col("from_start"), item))
        back = F.collect_list(F.when(F.col("from_end"), item))
    else:
        rows = past
        front = back = F.collect_set(item)
    grouped = rows.groupBy(spec.key, spec.label).agg(
        F.array_sort(front).alias("front_rows"),
        *([] if front is back else [F.array_sort(back).alias("back_rows")]),
        F.bool_or(is_current).alias("has_current"),
    )
    gap_columns = set(spec.gap_columns)

    def values(column: str) -> Column:
        rows_column = "back_rows" if front is not back and column in gap_columns else "front_rows"
        field_values = F.transform(F.col(rows_column), lambda r: r[column])
        return F.filter(field_values, lambda v: v.isNotNull()).alias(column)

    shared = gap_columns & set(spec.plain.values())
    if shared and front is not back:
        raise ValueError(f"columns used both plain and as a gap need history_bound: {sorted(shared)}")
    return grouped.where("has_current").select(spec.key, spec.label, *[values(c) for c in spec.columns])


def padded_sequences(lists: DataFrame, spec: SequenceSpec) -> DataFrame:
    """One fixed-length integer array per output name."""
    arrays = []
    for name in spec.names:
        if name in spec.gap:
            age, hour = spec.gap[name]
            arrays.append(gap_sequence(F.col(age), F.col(hour), spec.length).alias(name))
        else:
            arrays.append(pad_left(F.col(spec.plain[name]), spec.length, spec.keep).alias(name))
    return lists.select(spec.key, *arrays, spec.label)


def expanded_sequences(padded: DataFrame, spec: SequenceSpec, positional: bool = False) -> DataFrame:
    """Key, ``length`` integer columns per sequence, label.

    ``positional`` names the columns col_0, col_1_1 .. col_n_10, col_{n+1}.
    """
    columns = []
    for position, name in enumerate(spec.names, start=1):
        columns += expand(name, f"col_{position}" if positional else name, spec.length)
    key, label = F.col(spec.key), F.col(spec.label)
    if positional:
        key, label = key.alias("col_0"), label.alias(f"col_{len(spec.names) + 1}")
    return padded.select(key, *columns, label)


def build_sequences(
    mapping: DataFrame,
    features: DataFrame,
    sample: DataFrame,
    spec: SequenceSpec,
    history_bound: int | None = None,
    positional: bool = False,
) -> DataFrame:
    """Training rows from a history mapping, bucketed features and labelled sample keys."""
    joined = join_history(mapping, features, sample, spec)
    padded = padded_sequences(sequence_lists(joined, spec, history_bound), spec)
    return expanded_sequences(padded, spec, positional)
