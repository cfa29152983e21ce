"""The Spark derivation of the seven tables equals the SQL one, row for row."""

from __future__ import annotations

import collections

import pytest
from conftest import SF_SMALL
from oracle import duck

import __spark_entry__ as E
from ledgerscope.sources.fixture import fixture_tables

CTE = {
    "sales_assigned_accounts": "sa",
    "customers": "cu",
    "businesses": "bu",
    "accounts": "ac",
    "transactions": "tx",
    "post_credit_transactions": "pc",
    "daily_balances": "db",
}


@pytest.mark.parametrize("name", sorted(CTE))
def test_fixture_table_matches_sql(spark, name):
    df = getattr(fixture_tables(spark, SF_SMALL), name)
    cols = [c for c in df.columns if c != "BalanceDate"]
    got = collections.Counter(tuple(r) for r in df.select(*cols).collect())
    rel = duck(SF_SMALL).sql(E._with() + f"SELECT {', '.join(cols)} FROM {CTE[name]}")
    want = collections.Counter(tuple(r) for r in rel.fetchall())
    assert got == want


def test_fixture_counts_match_fixtures_md(spark):
    t = fixture_tables(spark, SF_SMALL)
    counts = {n: df.count() for n, df in t.as_dict().items()}
    assert counts["sales_assigned_accounts"] == 139 and counts["accounts"] == 190
    assert counts["transactions"] == 1500 and counts["post_credit_transactions"] == 6000
    assert counts["daily_balances"] == 161
