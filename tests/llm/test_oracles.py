"""Queries that SQL can express, against their SQL on the supplied tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF_MID
from oracle import compare

from ledgerscope.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MID}/{t}.parquet'")
    problems, n_spark, n_duck = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_MID)
    assert not problems, problems
    assert n_spark == n_duck > 0
