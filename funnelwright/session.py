"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import funnelwright

# Broadcasts are never hinted in this library: Spark broadcasts a side only after comparing
# its size with spark.sql.autoBroadcastJoinThreshold, and shuffles it beyond that.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Compressed: what a task sorts or gathers of it is some twelve times as much.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A file's size is no measure of its rows: encoded columns take several times as much once
    # read. Unless that is counted, tens of MB go through the driver for each such join.
    "spark.sql.sources.fileCompressionFactor": "8",
    "spark.sql.autoBroadcastJoinThreshold": "4m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bounds what a Python worker is handed at once where rows are long texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # The JVM never compiles methods above 8000 bytes of code; beyond that, Spark's split-up
    # expression code is faster than one generated method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# The functions that run inside tasks travel with them: executors need no copy of the package.
cloudpickle.register_pickle_by_value(funnelwright)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A one-machine session for tests and the bench; on a cluster use ``configure``."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("funnelwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python call site of every Column costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
