from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import pytest
from conftest import plan
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_measures import gap_rule, padded_rule

from funnelwright.operators.history import Exclusion, apply_exclusions, history_map, number_rows
from funnelwright.operators.sequences import (
    OUTPUT_ORDER,
    SequenceSpec,
    bucketize,
    build_sequences,
    expanded_sequences,
    join_history,
    padded_sequences,
    running_lists,
    sequence_lists,
    standard_spec,
)
from funnelwright.plans.sequence_prep import PrepInputs, PrepParams, run_sequence_prep, sequence_prep, staged_tables

SPEC = SequenceSpec(plain={"a": "fa", "b": "fb"}, gap={"g": ("age", "hr")})


def random_history(spark, seed: int, keys: int = 40, hot: int = 0):
    """Mapping, features and sample with nulls, duplicates, gaps in the numbering, missing current rows."""
    rng = random.Random(seed)
    features = {h: tuple(None if rng.random() < 0.25 else rng.randint(0, 9) for _ in range(2)) + (rng.randint(0, 200), None if rng.random() < 0.1 else rng.randint(0, 3)) for h in range(400)}
    mapping = []
    for k in range(keys):
        length = hot if hot and k == 0 else rng.randint(1, 30)
        seq = sorted(rng.sample(range(1, 4 * length + 5), length))
        current = seq[-1] if rng.random() < 0.9 else 999
        mapping += [(k, rng.randrange(420), current, s) for s in seq]
        if rng.random() < 0.3:
            mapping += [mapping[-1], (k, rng.randrange(400), current, current + 3)]
    sample = {k: rng.randint(0, 1) for k in range(keys) if rng.random() < 0.9 or k == 0}
    return mapping, features, sample


def frames(spark, mapping, features, sample):
    return (
        spark.createDataFrame(mapping, "cas_pkey int, cas_pkey_hist int, seq int, seq_hist int"),
        spark.createDataFrame([(k, *v) for k, v in features.items()], "cas_pkey int, fa int, fb int, age int, hr int"),
        spark.createDataFrame(list(sample.items()), "cas_pkey int, lift_frd_in int"),
    )


def expected(mapping, features, sample, keep):
    rows = {}
    for k in sample:
        own = sorted({(s, h, q) for key, h, q, s in mapping if key == k and h in features and s <= q})
        if not any(s == q for s, _, q in own):
            continue
        values = [[features[h][i] for _, h, _ in own if features[h][i] is not None] for i in range(4)]
        rows[k] = [*padded_rule(values[0], keep), *padded_rule(values[1], keep), *gap_rule(values[2], values[3]), sample[k]]
    return rows


@pytest.mark.parametrize("seed,keep,hot", [(1, "oldest", 0), (2, "latest", 0), (3, "oldest", 3000), (4, "latest", 3000)])
def test_sequences_equal_the_running_rule(spark, seed, keep, hot):
    mapping, features, sample = random_history(spark, seed, hot=hot)
    spec = SequenceSpec(plain=SPEC.plain, gap=SPEC.gap, keep=keep)
    joined = join_history(*frames(spark, mapping, features, sample), spec)
    want = expected(mapping, features, sample, keep)
    for bound in (None, 3000):
        out = expanded_sequences(padded_sequences(sequence_lists(joined, spec, bound), spec), spec)
        assert {r[0]: list(r[1:]) for r in out.collect()} == want, bound


def test_lists_equal_the_window_form(spark):
    mapping, features, sample = random_history(spark, 5, keys=30)
    mapping = [m for m in dict.fromkeys(mapping) if m[3] <= m[2]]
    joined = join_history(*frames(spark, mapping, features, sample), SPEC)
    window = {r.cas_pkey: (r.fa, r.fb, r.age, r.hr) for r in running_lists(joined, SPEC).collect()}
    grouped = {r.cas_pkey: (r.fa, r.fb, r.age, r.hr) for r in sequence_lists(joined, SPEC, 100).collect()}
    assert window == grouped and len(window) > 15


def test_running_lists_equal_a_window(spark):
    mapping, features, sample = random_history(spark, 8, keys=30)
    joined = join_history(*frames(spark, list(dict.fromkeys(mapping)), features, sample), SPEC)
    window = Window.partitionBy(SPEC.key, SPEC.label).orderBy("seq_hist")
    lists = joined.distinct().select("cas_pkey", "seq", "seq_hist", *[F.collect_list(c).over(window).alias(c) for c in SPEC.columns])
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.select("cas_pkey", *[F.array_sort(c) for c in SPEC.columns]).collect())
    found = running_lists(joined, SPEC)
    assert plain(found) == plain(lists.where("seq_hist = seq")) and found.count() > 15
    assert "Window" not in plan(found)


def test_unbounded_histories_are_cut_before_the_shuffle(spark):
    joined = join_history(*frames(spark, *random_history(spark, 6)), SPEC)
    text = plan(sequence_lists(joined, SPEC))
    assert text.count("WindowGroupLimit") >= 4
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_align_keeps_positions(spark):
    spec = SequenceSpec(plain={"a": "fa", "b": "fb"}, align=True, length=3)
    data = frames(spark, [(1, 10, 2, 1), (1, 11, 2, 2)], {10: (None, 5, 1, 1), 11: (7, None, 1, 1)}, {1: 1})
    out = build_sequences(*data, spec, history_bound=5).first()
    assert list(out[1:]) == [0, 0, 7, 0, 5, 0, 1]


def test_bucketize_rules(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 30.0), (3, None), (4, 300.0)], "k int, v double")
    v = F.col("v")
    out = bucketize(df, {"b": [(v < 10, 1), (v < 100, 2)], "c": [(v.isNull(), 9), (F.lit(True), 0)], "d": F.floor(v)}, ["k"])
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0, 3), (2, 2, 0, 30), (3, None, 9, None), (4, None, 0, 300)]
    assert dict(out.dtypes)["b"] == "int"


def history_rows(spark, seed: int = 11):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(1500):
        entity = 0 if k % 3 == 0 else rng.randint(1, 60)
        ts = None if rng.random() < 0.01 else start + dt.timedelta(minutes=rng.randint(0, 40 * 24 * 6) * 10)
        rows.append((k, entity if rng.random() > 0.02 else None, ts, (ts or start).date()))
    return rows, spark.createDataFrame(rows, "cas_pkey int, cm15 int, trans_ts timestamp, trans_dt date")


def test_numbering_equals_row_number(spark):
    rows, df = history_rows(spark)
    got = {r.cas_pkey: r.seq for r in number_rows(df.where("cm15 is not null"), "cm15", ["trans_ts", "cas_pkey"], "trans_ts", "seq").collect()}
    count = {}
    for k, entity, ts, _ in sorted(rows, key=lambda r: (r[2] or dt.datetime.min, r[0])):
        if entity is not None:
            count[entity] = count.get(entity, 0) + 1
            assert got[k] == count[entity]


@pytest.mark.parametrize("block_rows", [10, 37, 4096])
def test_history_map_equals_brute_force(spark, block_rows):
    rows, df = history_rows(spark)
    sample = df.where(F.col("cas_pkey") % 4 != 1).select("cas_pkey", *(["cm15"] if block_rows == 37 else []))
    got = {tuple(r)[:4] for r in history_map(df, sample, "cm15", "trans_ts", max_history=10, lookback_days=9, block_rows=block_rows).collect()}
    want, by_entity = set(), {}
    for k, entity, ts, day in sorted(rows, key=lambda r: (r[2] or dt.datetime.min, r[0])):
        if entity is None:
            continue
        own = by_entity.setdefault(entity, [])
        own.append((k, day))
        if k % 4 != 1:
            for i in range(max(len(own) - 10, 0), len(own)):
                if (day - own[i][1]).days <= 9:
                    want.add((k, own[i][0], len(own), i + 1))
    assert got == want


def test_exclusions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k int, v string")
    out = apply_exclusions(df, [Exclusion(df.where("v = 'b'"), "k")], F.col("v") != "d")
    assert {r.v for r in out.collect()} == {"a", "c"}


def prep_inputs(spark):
    rows, df = history_rows(spark)
    labels = df.select("cas_pkey", "trans_dt", F.when(F.col("cas_pkey") % 10 == 0, 1).otherwise(0).alias("lift_frd_in"))
    # Two raw columns for each bucketed feature of the layout.
    names = [*(n for n in OUTPUT_ORDER if n != "ngttime"), "time"]
    raw = {f"{n}_{i}": (F.col("cas_pkey") * (3 * k + i + 3) % 17).alias(f"{n}_{i}") for k, n in enumerate(names) for i in (0, 1)}
    features = df.select("cas_pkey", F.col("trans_dt"), *raw.values())
    rules = {f"{n}_buc_3b": [(F.col(f"{n}_0") < 5, 1), (F.col(f"{n}_1") < 9, 2), (F.lit(True), 3)] for n in names}
    return PrepInputs(df, labels, features, rules, [Exclusion(df.where("cas_pkey < 100"), "cas_pkey")])


def test_whole_preparation(spark, tmp_path):
    inputs = prep_inputs(spark)
    params = PrepParams("2024-01-15", "2024-02-05", 0.3, staging=str(tmp_path / "stages"), version="1")
    out = sequence_prep(inputs, params)
    assert len(out.columns) == 172 and out.columns[:2] == ["cas_pkey", "aav_1"] and out.columns[-1] == "lift_frd_in"
    text = plan(out)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    rows = out.collect()
    tables = staged_tables(inputs, params)
    assert {r.cas_pkey for r in rows} == {r.cas_pkey for r in tables["exclusions"].where("true").collect()} - {
        r[0] for r in history_rows(spark)[0] if r[1] is None
    }
    assert all(r.cas_pkey >= 100 for r in rows)
    direct = sequence_prep(inputs, PrepParams("2024-01-15", "2024-02-05", 0.3))
    assert sorted(map(repr, direct.collect())) == sorted(map(repr, rows))
    # A bound that is not stated takes the general path with the same result.
    features = bucketize(tables["vars_pull"], {**inputs.rules, "age_in_days": F.datediff(F.lit("2021-01-01").cast("date"), "trans_dt")}, ["cas_pkey"])
    general = build_sequences(tables["rnn_seq"], features, tables["exclusions"], standard_spec())
    assert sorted(map(repr, general.collect())) == sorted(map(repr, rows))

    path = run_sequence_prep(inputs, params, str(tmp_path / "out"))
    written = spark.read.csv(path)
    assert written.count() == len(rows) and len(written.columns) == 172
    with pytest.raises(Exception):
        run_sequence_prep(inputs, params, str(tmp_path / "out"))


def test_stages_are_reused_only_for_the_same_inputs(spark, tmp_path):
    inputs = prep_inputs(spark)
    where = {"staging": str(tmp_path / "stages"), "version": "1"}

    def keys(given, **more):
        params = PrepParams("2024-01-15", "2024-02-05", 0.3, **{**where, **more})
        return {r.cas_pkey for r in staged_tables(given, params)["exclusions"].collect()}

    every = keys(inputs)
    kept = keys(replace(inputs, keep=F.col("cas_pkey") % 2 == 0))
    assert kept == {k for k in every if k % 2 == 0} and kept != every
    spared = keys(replace(inputs, exclusions=()))
    assert spared > every
    assert keys(inputs) == every
    with pytest.raises(ValueError):
        PrepParams("2024-01-15", "2024-02-05", staging="somewhere")


@pytest.mark.parametrize("form", ["running", "bounded", "general"])
def test_a_key_with_two_labels_gives_two_rows(spark, form):
    mapping, features, _ = frames(spark, [(1, 10, 1, 1)], {10: (1, 2, 3, 1)}, {1: 0})
    sample = spark.createDataFrame([(1, 0), (1, 1)], ["cas_pkey", "lift_frd_in"])
    joined = join_history(mapping, features, sample, SPEC)
    lists = running_lists(joined, SPEC) if form == "running" else sequence_lists(joined, SPEC, 10 if form == "bounded" else None)
    column = SPEC.columns[0]
    assert sorted((r.lift_frd_in, len(r[column])) for r in lists.collect()) == [(0, 1), (1, 1)]


def test_history_without_bounds(spark):
    _, df = history_rows(spark)
    sample = df.select("cas_pkey")
    bounded = history_map(df, sample, "cm15", "trans_ts", max_history=4000, lookback_days=100_000)
    free = history_map(df, sample, "cm15", "trans_ts", max_history=None, lookback_days=None)
    assert sorted(map(tuple, free.collect())) == sorted(map(tuple, bounded.collect()))


def test_positional_names_and_parameters(spark):
    assert len(OUTPUT_ORDER) == 17
    data = frames(spark, [(1, 10, 1, 1)], {10: (1, 2, 3, 1)}, {1: 0})
    out = build_sequences(*data, SPEC, 10, positional=True)
    assert out.columns[0] == "col_0" and out.columns[1] == "col_1_1" and out.columns[-1] == "col_4"
    with pytest.raises(ValueError):
        PrepParams("2024-1-1", "2024-02-01")
    with pytest.raises(ValueError):
        PrepParams("2024-02-02", "2024-02-01")


@pytest.mark.parametrize("align", [False, True])
def test_carried_features_give_the_rows_of_a_join(spark, align):
    spec = replace(SPEC, align=align)
    _, df = history_rows(spark)
    # A row that comes twice, one without a key, features twice, features that differ, features that are missing.
    df = df.unionByName(df.where("cas_pkey = 7")).unionByName(df.where("cas_pkey = 9").withColumn("cas_pkey", F.lit(None).cast("long")))
    known = df.where("cas_pkey % 5 <> 0").select("cas_pkey", *[F.nullif(F.col("cas_pkey") % (i + 3), F.lit(1)).cast("int").alias(c) for i, c in enumerate(spec.columns)])
    more = known.where("cas_pkey in (7, 8)").unionByName(known.where("cas_pkey = 8").withColumn(spec.columns[0], F.lit(6)))
    features = known.unionByName(more)
    labels = df.select("cas_pkey", (F.col("cas_pkey") % 2).cast("int").alias("lift_frd_in"))
    labels = labels.unionByName(labels.where("cas_pkey = 12").withColumn("lift_frd_in", F.lit(1)))
    how = {"max_history": 6, "lookback_days": 9, "block_rows": 8}
    mapping = history_map(df, labels.where("cas_pkey % 3 <> 1"), "cm15", "trans_ts", **how)
    listed = history_map(df, labels.where("cas_pkey % 3 <> 1"), "cm15", "trans_ts", **how, carried=features)
    want, got = join_history(mapping, features, labels, spec), join_history(listed, None, labels, spec)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    rows = sorted(map(repr, want.collect()))
    assert sorted(map(repr, got.collect())) == rows and len(set(rows)) < len(rows)
    assert sorted(map(repr, sequence_lists(got, spec).collect())) == sorted(map(repr, sequence_lists(want, spec).collect()))
    with pytest.raises(ValueError):
        history_map(df, labels, "cm15", "trans_ts", max_history=None, carried=features)


def test_carried_pairs_are_shuffled_once(spark, tmp_path):
    _, df = history_rows(spark)
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    features = df.select("cas_pkey", *[F.lit(1).alias(c) for c in SPEC.columns])
    labels = df.select("cas_pkey", F.lit(0).alias("lift_frd_in"))
    listed = history_map(df, labels, "cm15", "trans_ts", max_history=6, lookback_days=9, block_rows=8, carried=features)
    lists = sequence_lists(join_history(listed, None, labels, SPEC), SPEC)
    lines = plan(lists).splitlines()
    unfolded = [i for i, line in enumerate(lines) if "Generate inline(pairs" in line]
    dealt = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert unfolded and dealt and not [line for line in lines[: unfolded[0]] if "Exchange" in line]
    assert lists.count() == features.where("cas_pkey is not null").join(df.where("cm15 is not null"), "cas_pkey", "left_semi").count()
