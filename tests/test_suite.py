"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import compare
import pytest

import __spark_entry__ as entry
from funnelwright.plans.suite import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert compare.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
