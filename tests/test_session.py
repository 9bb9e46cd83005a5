from __future__ import annotations

from conftest import plan
from pyspark.sql import functions as F

from funnelwright.session import SETTINGS, configure


def test_a_small_file_of_large_rows_is_not_broadcast(spark, tmp_path):
    # 60,000 rows of 160 bytes: well over 4 MB once read, far less as a file.
    wide = spark.range(0, 60_000, 1, 1).select("id", F.concat(F.repeat(F.lit("text "), 30), F.col("id").cast("string")).alias("text"))
    wide.write.parquet(str(tmp_path / "wide"))
    size = sum(f.stat().st_size for f in (tmp_path / "wide").glob("*.parquet"))
    assert size < 4 << 20
    read = configure(spark).read.parquet(str(tmp_path / "wide"))
    joined = spark.range(0, 10_000_000).join(read, "id")
    assert "BroadcastHashJoin" not in plan(joined)


def test_shuffled_rows_of_a_task_are_bounded(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == SETTINGS["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "16m"
