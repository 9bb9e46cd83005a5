"""Named SQL statements run one after another, each once: its rows are written and counted on the way."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelwright.sources.tables import cut_lineage

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class QueryRun:
    name: str
    status: str
    row_count: int = 0
    duration_seconds: float = 0.0
    error: str = ""
    rows: DataFrame | None = None


def query_batch(
    query: str = "", queries: Iterable[Mapping[str, str]] = (), generated: Mapping[str, str] | None = None
) -> list[tuple[str, str]]:
    """(name, sql) pairs: the single query, the listed ones that have SQL, the generated ones."""
    batch = [("adhoc_query", query.strip())] if query.strip() else []
    for position, item in enumerate(queries, start=1):
        sql = str(item.get("sql") or "").strip()
        if sql:
            batch.append((str(item.get("name") or f"query_{position}").strip(), sql))
    return batch + list((generated or {}).items())


def _storable(rows: DataFrame) -> DataFrame:
    """The rows with names that occur once (in any case) and types that files have."""
    names: list[str] = []
    for name in rows.columns:
        plain, number = name, 1
        while name.lower() in {n.lower() for n in names}:
            number += 1
            name = f"{plain}_{number}"
        names.append(name)
    rows = rows.toDF(*names)
    void = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NullType)]
    return rows.withColumns({n: F.lit(None).cast("string") for n in void}) if void else rows


def result_rows(spark: SparkSession, runs: Sequence[QueryRun]) -> DataFrame:
    """(name, row): every row of every successful statement as JSON text."""
    parts = [r.rows.select(F.lit(r.name).alias("name"), F.to_json(F.struct("*")).alias("row")) for r in runs if r.rows is not None and r.rows.columns]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "name string, row string")


def run_queries(spark: SparkSession, batch: Sequence[tuple[str, str]]) -> list[QueryRun]:
    """Run each statement; a failure is recorded and the next one still runs.

    One job a statement: the rows go to a table in the shared folder, which is what the record's ``rows``
    read, and their number is observed as they are written. Only that number comes to the driver.
    Columns of the same name get a number, columns of nulls are strings.
    """
    runs = []
    for name, sql in batch:
        text = (sql or "").strip()
        if not text:
            runs.append(QueryRun(name, "invalid_input", error="Empty SQL query."))
            continue
        started = time.monotonic()
        try:
            seen = Observation()
            rows, count = spark.sql(text), 0
            # A command gives no columns, and has run by now.
            if rows.columns:
                rows = cut_lineage(_storable(rows).observe(seen, F.count(F.lit(1)).alias("rows")))
                count = seen.get["rows"]
        except Exception as error:  # any analysis or run-time failure belongs in the record
            runs.append(QueryRun(name, "error", duration_seconds=time.monotonic() - started, error=str(error).strip()))
        else:
            runs.append(QueryRun(name, "success", count, time.monotonic() - started, rows=rows))
    return runs


def run_profile(spark: SparkSession, runs: Sequence[QueryRun]) -> DataFrame:
    """One row per statement: name, status, row count, seconds, error."""
    records = [(r.name, r.status, r.row_count, round(r.duration_seconds, 3), r.error) for r in runs]
    return spark.createDataFrame(records, PROFILE_SCHEMA)


def run_statements(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statements of a table (its other columns name their owners), each distinct text run once.

    Gives the table, its ``sql`` replaced by status, row_count and error, and the same with a ``row`` (JSON text)
    for every row of the results. The texts come to the driver, the rows don't.
    """
    spark = statements.sparkSession
    owners = [c for c in statements.columns if c != "sql"]
    keyed = statements.withColumn("statement", F.sha2("sql", 256))
    texts = sorted((r.statement, r.sql) for r in keyed.select("statement", "sql").distinct().collect())
    runs = run_queries(spark, texts)
    profile = run_profile(spark, runs).select(F.col("name").alias("statement"), "status", "row_count", "error")
    named = keyed.join(profile, "statement")
    rows = result_rows(spark, runs).withColumnRenamed("name", "statement").join(keyed.select(*owners, "statement"), "statement")
    return named.select(*owners, "status", "row_count", "error"), rows.select(*owners, "row")
