"""Sample, exclusions and history mapping that feed the sequence builder.

The rules of these stages are user input; only their inputs and output columns are fixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelwright.functions.measures import in_dates
from funnelwright.operators.sampling import DEFAULT_SAMPLE_RATE, label_preserving_sample

MAX_HISTORY = 10
LOOKBACK_DAYS = 30
# Rows of one entity per window group in history_map.
BLOCK_ROWS = 4096
# Unit of time within which an entity's rows are numbered by one task.
TIME_BUCKET = "minute"
# Pairs that a task takes at most, about, where they are carried along with their features.
PAIRS_A_PART = 250_000
# From here on the planner's size is a guess.
UNKNOWN_SIZE = 1 << 44


def initial_sample(
    transactions: DataFrame,
    labels: DataFrame,
    start: str,
    end: str,
    rate: float = DEFAULT_SAMPLE_RATE,
    key: str = "cas_pkey",
    date: str = "trans_dt",
    label: str = "lift_frd_in",
) -> DataFrame:
    """Transactions of the date range with their label: all labelled ones, ``rate`` of the others."""
    days = in_dates(date, start, end)
    wanted = labels.where(days).select(key, date, label)
    return label_preserving_sample(transactions.where(days), wanted, key, [key, date], label, rate)


@dataclass(frozen=True)
class Exclusion:
    """Drop rows whose ``on`` value occurs in ``rows``."""

    rows: DataFrame
    on: str


def apply_exclusions(
    sample: DataFrame, exclusions: Iterable[Exclusion] = (), keep: Column | None = None
) -> DataFrame:
    """The sample without rows found in an exclusion table and without rows failing ``keep``."""
    if keep is not None:
        sample = sample.where(keep)
    for exclusion in exclusions:
        sample = sample.join(exclusion.rows.select(exclusion.on), exclusion.on, "left_anti")
    return sample


def number_rows(df: DataFrame, entity: str, order: Sequence[str], time: str, name: str, bucket: str = TIME_BUCKET) -> DataFrame:
    """``row_number() over (partition by entity order by ...)`` without one task per entity.

    Rows are numbered within (entity, time bucket) and shifted by the number of earlier
    rows of the entity, so a hot entity is spread over its time buckets. ``time`` must be
    the first order column; rows without a time come first.
    """
    bucketed = df.withColumn("time_bucket", F.coalesce(F.date_trunc(bucket, time), F.lit("0001-01-01").cast("timestamp")))
    sizes = bucketed.groupBy(entity, "time_bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    earlier = Window.partitionBy(entity).orderBy("time_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        entity, "time_bucket", F.coalesce(F.sum("bucket_rows").over(earlier), F.lit(0)).alias("row_offset")
    )
    within = Window.partitionBy(entity, "time_bucket").orderBy(*order)
    numbered = bucketed.withColumn("row_in_bucket", F.row_number().over(within))
    return (
        numbered.join(offsets, [entity, "time_bucket"])
        .withColumn(name, F.col("row_offset") + F.col("row_in_bucket"))
        .drop("time_bucket", "row_offset", "row_in_bucket")
    )


def history_map(
    transactions: DataFrame,
    sample: DataFrame,
    entity: str,
    time: str,
    key: str = "cas_pkey",
    date: str = "trans_dt",
    max_history: int | None = MAX_HISTORY,
    lookback_days: int | None = LOOKBACK_DAYS,
    block_rows: int = BLOCK_ROWS,
    bucket: str = TIME_BUCKET,
    carried: DataFrame | None = None,
) -> DataFrame:
    """(current, historical) pairs: each sampled transaction with the latest rows of its entity.

    At most ``max_history`` pairs per transaction, itself included, none older than
    ``lookback_days``; a transaction without an entity has none. The rows of an entity are cut into blocks of ``block_rows`` by their
    number; the last ``max_history - 1`` rows of a block are copied in front of the next
    one. Every window group therefore has a bounded size however hot the entity is, and no
    pair outside the result is ever built. A sample that also names the entity is used to
    leave out all other entities first.

    ``max_history=None`` keeps all earlier rows and ``lookback_days=None`` any age; without a
    bound on the history the pairs come from a join of the entity's rows, as many as the result has.

    ``carried`` has columns by ``key`` that each historical row brings along, as by a join on its key; a row with none
    there is in no pair. They meet the transactions, not the pairs, which are many times as many, and the result is
    one row per current row: its pairs are the array ``pairs`` (see ``join_history``). It needs ``max_history``.
    """
    if max_history is not None and not 1 <= max_history <= block_rows:
        raise ValueError("max_history must be between 1 and block_rows")
    if max_history is None and carried is not None:
        raise ValueError("carried columns need max_history")
    keys = sample.select(key).distinct().withColumn("sampled", F.lit(True))
    slim = transactions.select(key, entity, time, date).where(F.col(entity).isNotNull())
    if entity in sample.columns:
        # Entities without a sampled row need no history; most of the long tail ends here.
        slim = slim.join(sample.select(entity).distinct(), entity, "left_semi")
    marked = slim.join(keys, key, "left").withColumn("sampled", F.col("sampled").isNotNull())
    numbered = number_rows(marked, entity, [time, key], time, "seq", bucket)
    recent = F.lit(True) if lookback_days is None else F.col("date_hist") >= F.date_sub(F.col(date), lookback_days)
    if max_history is None:
        past = numbered.select(
            entity, F.col(key).alias("key_hist"), F.col("seq").alias("seq_hist"), F.col(date).alias("date_hist")
        )
        now = numbered.where("sampled").select(entity, key, "seq", date)
        return _named_pairs(now.join(past, entity).where((F.col("seq_hist") <= F.col("seq")) & recent), key, date)

    brought = []
    if carried is not None:
        columns = [c for c in carried.columns if c != key]
        own = carried.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("brought"))
        numbered = numbered.join(own, key, "left")
        brought = [F.col("brought")]

    block = F.floor((F.col("seq") - 1) / block_rows)
    position = (F.col("seq") - 1) % block_rows
    copied = position >= block_rows - (max_history - 1)
    copies = F.when(copied, F.array(block, block + 1)).otherwise(F.array(block))
    blocks = numbered.withColumn("own_block", block).withColumn("block", F.explode(copies))

    window = Window.partitionBy(entity, "block").orderBy("seq").rowsBetween(1 - max_history, 0)
    item = F.struct(
        F.col(key).alias("key_hist"), F.col("seq").alias("seq_hist"), F.col(date).alias("date_hist"), *brought
    )
    current = blocks.withColumn("items", F.collect_list(item).over(window)).where(
        F.col("sampled") & (F.col("block") == F.col("own_block"))
    )
    if carried is None:
        return _named_pairs(current.select(key, "seq", date, F.inline("items")).where(recent), key, date)
    if lookback_days is not None:
        oldest = F.date_sub(F.col(date), lookback_days)
        current = current.withColumn("items", F.filter("items", lambda i: i["date_hist"] >= oldest))

    def pairs_with(item: Column) -> Column:
        names = [item["key_hist"].alias(f"{key}_hist"), item["seq_hist"].cast("int").alias("seq_hist")]
        rows = F.transform(item["brought"], lambda b: F.struct(*names, *[b[c].alias(c) for c in columns]))
        return F.coalesce(rows, F.array())

    fields = [f"{key}_hist", "seq_hist", *columns]
    listed = current.select(key, F.col("seq").cast("int").alias("seq"), date, F.flatten(F.transform("items", pairs_with)).alias("pairs"))
    # Shuffled as an array for each field, with the distance in place of the number: both compress better.
    apart = listed.select(key, "seq", date, *[F.col("pairs")[c].alias(c) for c in fields])
    apart = apart.withColumn("seq_hist", F.transform("seq_hist", lambda s: F.col("seq") - s))
    parts = _parts_for(transactions, max_history)
    dealt = apart.repartition(parts, key) if parts else apart.repartition(key)
    dealt = dealt.withColumn("seq_hist", F.transform("seq_hist", lambda s: F.col("seq") - s))
    return dealt.select(key, "seq", date, F.arrays_zip(*fields).alias("pairs"))


def _parts_for(transactions: DataFrame, max_history: int) -> int | None:
    """In how many parts the pairs are dealt out, by the planner's size of the transactions; None where it has none.

    Shuffled arrays are small beside the pairs that a task sorts of them, so their size says little.
    """
    size = int(str(transactions._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = size // transactions._jdf.schema().defaultSize()
    return 1 + rows * max_history // PAIRS_A_PART if size < UNKNOWN_SIZE else None


def _named_pairs(pairs: DataFrame, key: str, date: str) -> DataFrame:
    return pairs.select(
        key,
        F.col("key_hist").alias(f"{key}_hist"),
        F.col("seq").cast("int").alias("seq"),
        F.col("seq_hist").cast("int").alias("seq_hist"),
        date,
        F.col("date_hist").alias(f"{date}_hist"),
    )


def pull_features(features: DataFrame, mapping: DataFrame, key: str = "cas_pkey") -> DataFrame:
    """Feature rows of the transactions that occur in a history."""
    needed = mapping.select(F.col(f"{key}_hist").alias(key))
    return features.join(needed, key, "left_semi")
