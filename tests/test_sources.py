from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelwright.sources.batch import query_batch, run_profile, run_queries
from funnelwright.sources.tables import (
    Source,
    cut_lineage,
    drop_table,
    fingerprint,
    has_rows,
    latest_rows,
    materialize,
    profile,
    read_table,
    register_views,
    shared_folder,
    write_training_csv,
    write_training_parquet,
)


def test_read_formats_and_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    for fmt in ("parquet", "orc", "json"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert read_table(spark, Source(str(tmp_path / fmt), fmt)).count() == 2
    df.write.csv(str(tmp_path / "csv"), header=True)
    assert read_table(spark, Source(str(tmp_path / "csv"), "csv", {"header": "true"})).columns == ["i", "s"]
    with pytest.raises(Exception):
        read_table(spark, Source(str(tmp_path / "none"), "parquet"))
    assert Source.staged("p", "d", "f", "t") == Source("p.d.f_t", "bigquery")


def test_materialize_skips_a_filled_target(spark, tmp_path):
    target = Source(str(tmp_path / "stage"), "parquet")
    assert not has_rows(spark, target)
    assert materialize(spark.range(3).toDF("x"), target).count() == 3
    assert materialize(spark.range(9).toDF("x"), target).count() == 3
    empty = Source(str(tmp_path / "empty"), "parquet")
    materialize(spark.range(0).toDF("x"), empty)
    assert not has_rows(spark, empty) and materialize(spark.range(2).toDF("x"), empty).count() == 2
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert materialize(spark.range(4).toDF("x"), target).count() == 4
    assert fingerprint(a=1, b="x") == fingerprint(b="x", a=1) != fingerprint(a=2, b="x")


def test_catalog_table_stage(spark):
    spark.sql("DROP TABLE IF EXISTS stage_table_x")
    target = Source("stage_table_x")
    assert not has_rows(spark, target)
    assert materialize(spark.range(3).toDF("x"), target).count() == 3
    assert materialize(spark.range(5).toDF("x"), target).count() == 3
    drop_table(spark, "stage_table_x")
    drop_table(spark, "stage_table_x")
    assert not has_rows(spark, target)


def test_latest_rows_and_profile(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 7), "a" if i % 2 else "b") for i in range(20)], "i int, date_time timestamp, s string")
    got = latest_rows(df, "s = 'a'", 3, tie_columns=("i",)).collect()
    assert [r.i for r in got] == sorted((i for i in range(20) if i % 2), key=lambda i: (i % 7, i))[-3:]
    assert [r.i for r in latest_rows(df, None, 100, tie_columns=("i",)).collect()] == sorted(range(20), key=lambda i: (i % 7, i))
    rows = {r.table_name: (r.row_count, r.column_count) for r in profile({"a": df, "b": df}, {"b": F.col("i") < 5}).collect()}
    assert rows == {"a": (20, 3), "b": (5, 3)}


def test_training_csv_is_headerless_and_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "", "x")], "a int, b int, c string, d string").coalesce(1)
    path = write_training_csv(df, str(tmp_path / "out"))
    assert path.endswith("/out/data")
    assert "".join(p.read_text() for p in (tmp_path / "out" / "data").glob("part-*")) == "1,,,x\n"
    with pytest.raises(Exception):
        write_training_csv(df, str(tmp_path / "out"))
    write_training_parquet(df, str(tmp_path / "pq"))


def test_query_batch(spark):
    register_views({"batch_view": spark.range(4)})
    batch = query_batch(" SELECT * FROM batch_view ", [{"sql": ""}, {"sql": "SELECT nope"}, {"name": "n", "sql": "SELECT 1"}], {"stage": " "})
    assert [name for name, _ in batch] == ["adhoc_query", "query_2", "n", "stage"]
    runs = run_queries(spark, batch)
    assert [(r.status, r.row_count) for r in runs] == [("success", 4), ("error", 0), ("success", 1), ("invalid_input", 0)]
    assert runs[0].rows.count() == 4 and runs[1].error and runs[3].error == "Empty SQL query."
    assert run_profile(spark, runs).count() == 4 and run_profile(spark, []).count() == 0


def test_cut_lineage_uses_the_shared_folder(spark):
    df = spark.range(5).select(F.col("id"), F.struct(F.lit("x").alias("a")).alias("s"))
    again = cut_lineage(df)
    assert sorted(r.id for r in again.collect()) == list(range(5))
    assert all(shared_folder(spark) in f for f in again.inputFiles())
