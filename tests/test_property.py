"""Random tables: both reports equal the row-level SQL evaluated by DuckDB.

Small key pools make duplicates, nulls, shared e-mails and repeated balance
rows common, which is where the weighted (pair-free) plans could go wrong.
"""

from __future__ import annotations

import collections
import datetime as dt
from decimal import Decimal

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from ledgerscope.functions.dates import DateWindow
from ledgerscope.plans.assignment import assignment_rows
from ledgerscope.plans.salesperson import sales_person_rows

WINDOW = DateWindow.of("1997-01-01", "1997-12-31")
EMAILS = ["e1", "e2", "e3", None]
HOLDERS = ["Customer", "Business", "Other", None]
CODES = ["P", "Q", None]
IDS = ["i1", "i2", "i3", None]
NUMS = ["n1", "n2", "n3", None]
DAYS = [dt.datetime(1996, 12, 31, 23), dt.datetime(1997, 1, 1), dt.datetime(1997, 6, 1, 5), dt.datetime(1997, 12, 31), dt.datetime(1997, 12, 31, 0, 0, 1)]
money = st.one_of(st.none(), st.decimals(min_value=-50, max_value=500, places=4, allow_nan=False, allow_infinity=False))
fee = st.sampled_from([Decimal("10.75"), Decimal("26.88"), Decimal("53.75"), Decimal("1.10"), Decimal("10.754"), None])

tables = st.fixed_dictionaries(
    {
        "sales_assigned_accounts": st.lists(
            st.tuples(st.sampled_from(CODES), st.sampled_from(["A", "B", None]), st.sampled_from(EMAILS),
                      st.sampled_from(["n1", "n2"]), st.sampled_from(["p1", None]), st.sampled_from(HOLDERS)),
            max_size=7),
        "customers": st.lists(st.tuples(st.sampled_from(IDS), st.sampled_from(EMAILS)), max_size=4),
        "businesses": st.lists(st.tuples(st.sampled_from(IDS), st.sampled_from(EMAILS)), max_size=3),
        "accounts": st.lists(st.tuples(st.sampled_from(NUMS), st.sampled_from(IDS), st.sampled_from(IDS)), max_size=4),
        "transactions": st.lists(
            st.tuples(st.sampled_from(EMAILS + ["x"]), st.sampled_from(["Outflow", "Inflow", "Reversal", None]),
                      money, fee, st.sampled_from(DAYS)),
            max_size=6),
        "post_credit_transactions": st.lists(st.tuples(st.sampled_from(NUMS), money, st.sampled_from(DAYS)), max_size=5),
        "daily_balances": st.lists(
            st.tuples(st.sampled_from(EMAILS), st.sampled_from(HOLDERS), money, money), max_size=5),
    }
)

DDL = {
    "sa": ("SalesPersonCode VARCHAR, AssignedTo VARCHAR, Email VARCHAR, AccountName VARCHAR, "
           "PhoneNumber VARCHAR, AccountHolder VARCHAR", "sales_assigned_accounts"),
    "cu": ("Id VARCHAR, UserName VARCHAR", "customers"),
    "bu": ("Id VARCHAR, Email VARCHAR", "businesses"),
    "ac": ("AccountNumber VARCHAR, CustomerId VARCHAR, BusinessId VARCHAR", "accounts"),
    "tx": ("EmailAddress VARCHAR, TransactionType VARCHAR, Amount DECIMAL(20,6), TransactionFee DECIMAL(20,6), "
           "DateCreated TIMESTAMP", "transactions"),
    "pc": ("BeneficiaryAccountNumber VARCHAR, Amount DECIMAL(20,6), RequestDate TIMESTAMP", "post_credit_transactions"),
    "db": ("UserName VARCHAR, AccountHolder VARCHAR, TotalLedgerBalance DECIMAL(20,6), "
           "TotalAvailableBalance DECIMAL(20,6)", "daily_balances"),
}


def duck_of(rows: dict) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, (cols, source) in DDL.items():
        con.execute(f"CREATE TABLE {name} ({cols})")
        data = rows[source]
        if data:
            marks = ", ".join("?" * len(data[0]))
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", [list(r) for r in data])
    return con


def multiset(rows) -> collections.Counter:
    return collections.Counter(tuple(r) for r in rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=tables)
def test_reports_equal_row_level_sql(spark, make_tables, rows):
    t = make_tables(**rows)
    con = duck_of(rows)

    r2 = sales_person_rows(t, WINDOW)
    want = con.sql(E._sales_person_sql(WINDOW, WINDOW, fixture=False)).fetchall()
    assert multiset(r2.collect()) == multiset(want)

    r1 = assignment_rows(t, "P", WINDOW)
    got = r1.collect()
    want = con.sql(E._assignment_sql(WINDOW, WINDOW, fixture=False, person="P")).fetchall()
    assert multiset(got) == multiset(want)

    # SURVEY 7.4: rows = sum over P's assignment rows of max(1, balance rows x P's rows of the pair)
    mine = [r for r in rows["sales_assigned_accounts"] if r[0] == "P"]
    expected = 0
    for r in mine:
        email, holder = r[2], r[5]
        k = sum(1 for x in mine if x[2] == email and x[5] == holder) if email and holder else 0
        d = sum(1 for b in rows["daily_balances"] if b[0] == email and b[1] == holder) if email and holder else 0
        expected += max(1, k * d)
    assert len(got) == expected
