"""Every registered query equals its DuckDB oracle (exact, order-insensitive)."""

from __future__ import annotations

import pytest
from conftest import SF_MID, SF_SMALL
from oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as E

QUERIES = E._QUERIES
ORACLES = E.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)
    assert set(ORACLES) <= set(E.queries())


@pytest.fixture(scope="module")
def con_small():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_small(spark, con_small, name):
    problems, n_spark, n_duck = compare(spark, con_small, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert not problems, problems
    assert n_spark == n_duck


@pytest.mark.parametrize("name", ["assignment_summary", "sales_person_summary", "assignment_review_historic"])
def test_reports_match_oracle_mid(spark, name):
    problems, _, _ = compare(spark, duck(SF_MID), name, QUERIES[name], ORACLES[name], SF_MID)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"assignment_summary_null_end"}))
def test_no_column_is_empty(spark, name):
    """A query whose column is null in every row would compare nothing."""
    df = QUERIES[name](spark, SF_SMALL)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    assert all(counts.values()), counts


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields][:2] == ["salespersoncode", "assignedto"]
