"""Reading, staging, profiling and writing tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_FORMATS = ("parquet", "orc", "csv", "json")


@dataclass(frozen=True)
class Source:
    """Where a table lives: a catalog table, a file path, or a connector such as ``bigquery``.

    ``location`` is a table name, a path, or for a connector the table (or ``SELECT``) text.
    """

    location: str
    format: str = "table"
    options: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def staged(project: str, dataset: str, folder: str, table: str, format: str = "bigquery") -> Source:
        """A staging table addressed as ``project.dataset.folder_table``."""
        return Source(f"{project}.{dataset}.{folder}_{table}", format)


def read_table(spark: SparkSession, source: Source) -> DataFrame:
    """DataFrame over the source; errors are raised, never turned into None."""
    reader = spark.read.options(**source.options)
    if source.format == "table":
        return reader.table(source.location)
    if source.format in FILE_FORMATS:
        return reader.format(source.format).load(source.location)
    is_query = source.location.lstrip().lower().startswith(("select", "with"))
    return reader.format(source.format).option("query" if is_query else "table", source.location).load()


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Expose DataFrames to SQL text under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_or_none(spark: SparkSession, source: Source) -> DataFrame | None:
    try:
        return read_table(spark, source)
    except AnalysisException as error:
        if error.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def has_rows(spark: SparkSession, source: Source) -> bool:
    """True if the table exists and holds at least one row."""
    df = table_or_none(spark, source)
    return df is not None and not df.isEmpty()


def fingerprint(**parameters: object) -> str:
    """Short stable text for a set of stage parameters, used in the stage's table name."""
    text = json.dumps(parameters, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def materialize(df: DataFrame, target: Source, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the target unless it already has rows, then read the target.

    A finished stage is a plain table in shared storage, so a later stage restarts from it
    rather than from the raw inputs. File targets count as finished only with their
    ``_SUCCESS`` marker. Put ``fingerprint(...)`` into the location so that changed
    parameters never meet an old table.
    """
    spark = df.sparkSession
    if not (_is_finished(spark, target) and has_rows(spark, target)):
        writer = df.write.mode("overwrite").options(**target.options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if target.format == "table":
            writer.saveAsTable(target.location)
        else:
            writer.format(target.format).save(target.location)
    return read_table(spark, target)


def _is_finished(spark: SparkSession, target: Source) -> bool:
    if target.format not in FILE_FORMATS:
        return True
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target.location}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    For a small result that several branches of a job start from: they read the table
    instead of repeating its plan, and a lost executor costs no recomputation. The table goes
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def profile(tables: Mapping[str, DataFrame], where: Mapping[str, Column | str] | None = None) -> DataFrame:
    """One row per table: name, row count (of the rows meeting the predicate), column count."""
    where = where or {}
    rows = []
    for name, df in tables.items():
        kept = df.where(where[name]) if name in where else df
        rows.append(
            kept.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")
            )
        )
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def latest_rows(
    df: DataFrame,
    where: Column | str | None = None,
    max_rows: int = 100_000,
    sort_column: str = "date_time",
    tie_columns: tuple[str, ...] = (),
) -> DataFrame:
    """The latest ``max_rows`` rows by ``sort_column``, in ascending order.

    Sort plus limit is one top-k pass: each task keeps its own best rows, so a count first
    is not needed.
    """
    kept = df if where is None else df.where(where)
    order = [sort_column, *tie_columns]
    newest = kept.orderBy(*[F.col(c).desc() for c in order]).limit(max_rows)
    return newest.orderBy(*[F.col(c).asc() for c in order])


def write_training_csv(df: DataFrame, base_path: str) -> str:
    """Headerless comma-separated files in ``{base_path}/data``; fails if it exists.

    Null and '' are both written as an empty field.
    """
    path = f"{base_path}/data"
    writer = df.write.mode("errorifexists").option("header", False).option("sep", ",")
    writer.option("nullValue", "").option("emptyValue", "").csv(path)
    return path


def write_training_parquet(df: DataFrame, base_path: str) -> str:
    """The same rows with named, typed columns."""
    path = f"{base_path}/data"
    df.write.mode("errorifexists").parquet(path)
    return path
