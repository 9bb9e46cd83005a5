"""From raw documents to a training mix: each stage calls one operator of ``funnelwright.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelwright.llm import decontam, langid, mixing, secrets, simhash
from funnelwright.llm.common import cut_lineage, fresh, row_hash, table
from funnelwright.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Texts further than this from every language are no prose in any of them.
LEAST_SCORE = 0.2


def _without(docs: DataFrame, row: str, bad: DataFrame) -> DataFrame:
    """``docs`` (with their row hash in column ``row``) that aren't listed, as they were.

    The list is written first: where it is short, Spark sees that and moves no text.
    """
    return docs.join(cut_lineage(bad.select(row).distinct()), row, "left_anti").drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learnt from the labelled ones; those without letters, or unlike all, go."""
    row = fresh(docs, "row")
    keyed = docs.withColumn(row, row_hash("doc_id"))
    found = langid.predict(keyed, langid.profiles(docs), key=row)
    return _without(keyed, row, found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (three words, at most three differing bits)."""
    return simhash.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go."""
    row = fresh(docs, "row")
    keyed = docs.withColumn(row, row_hash("doc_id"))
    return _without(keyed, row, decontam.leaks(keyed, table(spark, sf_dir, "benchmark"), key=row)).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the text; the documents stay."""
    kept = secrets.redacted(docs, secrets.scan(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each use, with weight, epoch, block_rank and doc_rank."""
    return mixing.mixed(docs, mixing.schedule(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: Trained models and fingerprints can't be said in SQL; the tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a table in the shared folder."""
    docs = table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
