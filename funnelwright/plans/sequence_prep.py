"""Training sequences from raw transactions: sample, exclude, map histories, bucket, expand, write."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.functions.measures import age_in_days, in_dates, lookback_dates
from funnelwright.operators.history import (
    LOOKBACK_DAYS,
    MAX_HISTORY,
    Exclusion,
    apply_exclusions,
    history_map,
    initial_sample,
    pull_features,
)
from funnelwright.operators.sampling import DEFAULT_SAMPLE_RATE
from funnelwright.operators.sequences import (
    BucketRule,
    SequenceSpec,
    bucketize,
    build_sequences,
    standard_spec,
)
from funnelwright.sources.tables import Source, fingerprint, materialize, write_training_csv


@dataclass(frozen=True)
class PrepParams:
    """Dates, sampling and the names of the transaction columns.

    ``staging`` is a folder in shared storage; the four stages are then written below it and
    reused by a rerun with the same parameters, inputs, rules, exclusions and ``version``, the
    caller's name for the state of the input data (a load date, a snapshot id), which staging
    needs. Without ``staging`` nothing is staged. ``max_history`` and ``lookback_days`` may be
    None: no bound.
    """

    start_dt: str
    end_dt: str
    sample_rate: float = DEFAULT_SAMPLE_RATE
    entity: str = "cm15"
    time: str = "trans_ts"
    key: str = "cas_pkey"
    date: str = "trans_dt"
    label: str = "lift_frd_in"
    max_history: int | None = MAX_HISTORY
    lookback_days: int | None = LOOKBACK_DAYS
    reference_date: str = "2021-01-01"
    staging: str = ""
    version: str = ""

    def __post_init__(self) -> None:
        if len(self.start_dt) != 10 or len(self.end_dt) != 10:
            raise ValueError("Dates must be in YYYY-MM-DD format.")
        if self.start_dt > self.end_dt:
            raise ValueError("start_dt must be less than or equal to end_dt.")
        if self.staging and not self.version:
            raise ValueError("staging needs a version of the input data")


@dataclass(frozen=True)
class PrepInputs:
    """Tables and rules. ``rules`` maps bucket columns to their rule; they are the user's own."""

    transactions: DataFrame
    labels: DataFrame
    features: DataFrame
    rules: Mapping[str, BucketRule]
    exclusions: Sequence[Exclusion] = field(default_factory=tuple)
    keep: Column | None = None


def _plan_text(df: DataFrame) -> str:
    """The analysed plan, without the numbers that differ from run to run."""
    return re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().analyzed().toString())


def staged_tables(inputs: PrepInputs, params: PrepParams) -> dict[str, DataFrame]:
    """init_sample, exclusions, rnn_seq and vars_pull, each built on the one before."""
    p = params
    mark = fingerprint(**{k: v for k, v in vars(p).items() if k != "staging"})

    def stage(name: str, df: DataFrame, *inputs: DataFrame) -> DataFrame:
        if not p.staging:
            return df
        nonlocal mark
        # What a stage is made of: the mark of the one before, its own plan, and its inputs' plans.
        mark = fingerprint(parent=mark, plans=[_plan_text(x) for x in (df, *inputs)])
        return materialize(df, Source(f"{p.staging.rstrip('/')}/{name}_{mark}", "parquet"))

    sample = stage(
        "init_sample",
        initial_sample(
            inputs.transactions, inputs.labels, p.start_dt, p.end_dt, p.sample_rate, p.key, p.date, p.label
        ),
    )
    kept = stage("exclusions", apply_exclusions(sample, inputs.exclusions, inputs.keep))
    # Scan only the days a history can reach (30 days back unless set wider).
    oldest = F.least(
        F.date_sub(F.lit(p.start_dt).cast("date"), p.lookback_days or 0),
        F.lit(str(lookback_dates(p.start_dt)["start_dt_20"])).cast("date"),
    )
    reachable = inputs.transactions
    if p.lookback_days is None:
        reachable = reachable.where(F.col(p.date) <= F.lit(p.end_dt).cast("date"))
    else:
        reachable = reachable.where(in_dates(p.date, oldest, p.end_dt))
    mapping = stage(
        "rnn_seq",
        history_map(reachable, kept, p.entity, p.time, p.key, p.date, p.max_history, p.lookback_days),
    )
    pulled = stage("vars_pull", pull_features(inputs.features, mapping, p.key))
    return {"init_sample": sample, "exclusions": kept, "rnn_seq": mapping, "vars_pull": pulled}


def sequence_prep(
    inputs: PrepInputs, params: PrepParams, spec: SequenceSpec | None = None, positional: bool = False
) -> DataFrame:
    """Training rows: key, the expanded sequences, label."""
    p = params
    spec = spec or standard_spec(key=p.key, label=p.label)
    tables = staged_tables(inputs, p)
    rules = dict(inputs.rules)
    if "age_in_days" in spec.columns and "age_in_days" not in rules:
        rules["age_in_days"] = age_in_days(p.date, p.reference_date)
    features = bucketize(tables["vars_pull"], rules, [p.key])
    # history_map gives at most max_history pairs per key.
    return build_sequences(tables["rnn_seq"], features, tables["exclusions"], spec, p.max_history, positional)


def run_sequence_prep(
    inputs: PrepInputs,
    params: PrepParams,
    output_path: str,
    spec: SequenceSpec | None = None,
    positional: bool = True,
    write: Callable[[DataFrame, str], str] = write_training_csv,
) -> str:
    """Build and write the training rows; returns the path of the data."""
    return write(sequence_prep(inputs, params, spec, positional), output_path)
