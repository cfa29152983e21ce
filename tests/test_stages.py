
from __future__ import annotations

from decimal import Decimal

from conftest import D, ts

from ledgerscope.functions.dates import DateWindow
from ledgerscope.operators import stages as S
from ledgerscope.sources.tables import read_catalog_tables

YEAR = DateWindow.of("1997-01-01", "1997-12-31")


def sa(code, email, holder, to="A"):
    return (code, to, email, "n", "p", holder)


def test_c1_assigned_accounts(make_tables):
    t = make_tables(sales_assigned_accounts=[sa("P", "e1", "Customer"), sa("Q", "e2", "Customer"), sa(None, "e3", "Customer")])
    assert [r.Email for r in S.assigned_accounts(t.sales_assigned_accounts, "P").collect()] == ["e1"]
    assert S.assigned_accounts(t.sales_assigned_accounts, None).count() == 0
    assert S.assigned_accounts(t.sales_assigned_accounts).count() == 3


def test_c2_counts_from_base_table(make_tables):
    t = make_tables(
        sales_assigned_accounts=[sa("P", "e1", "Customer"), sa("P", "e2", "Business"), sa("P", "e3", None), sa(None, "e4", "Business")]
    )
    rows = {r.SalesPersonCode: (r.numberofbusiness, r.numberofcustomers) for r in S.assignment_counts(t.sales_assigned_accounts).collect()}
    assert rows == {"P": (1, 1), None: (1, 0)}


def test_c3_holders_left_joins_keep_rows(make_tables):
    # e1 customer found; e2 business found; e3 customer without record; e4 holder "Other"
    t = make_tables(
        sales_assigned_accounts=[sa("P", "e1", "Customer"), sa("P", "e2", "Business"), sa("P", "e3", "Customer"), sa("P", "e4", "Other")],
        customers=[("c1", "e1"), ("c9", "e2")],
        businesses=[("b2", "e2"), ("b9", "e1")],
    )
    got = sorted((r.Email, r.CustomerId, r.BusinessId) for r in S.account_holders(t.sales_assigned_accounts, t.customers, t.businesses).collect())
    assert got == [("e1", "c1", None), ("e2", None, "b2"), ("e3", None, None), ("e4", None, None)]


def test_c4_or_join_as_one_equi_join(make_tables):
    # Account X is owned by both c1 and b2: it resolves once for each holder row.
    t = make_tables(
        sales_assigned_accounts=[sa("P", "e1", "Customer"), sa("P", "e2", "Business"), sa("P", "e3", "Customer")],
        customers=[("c1", "e1")],
        businesses=[("b2", "e2")],
        accounts=[("X", "c1", "b2"), ("Y", "c1", None), ("Z", None, "b2"), ("W", "c3", None)],
    )
    holders = S.account_holders(t.sales_assigned_accounts, t.customers, t.businesses)
    got = sorted((r.Email, r.AccountNumber) for r in S.resolve_accounts(holders, t.accounts).collect())
    assert got == [("e1", "X"), ("e1", "Y"), ("e2", "X"), ("e2", "Z")]


def test_c5_inflow_by_email_and_code(make_tables):
    # e1 (P, customer c1: accounts A, B), e2 (P and Q, business b2: account C).
    # credits in 1997: A 10, B 5, C 7; one credit outside the window; one to an unknown account.
    t = make_tables(
        sales_assigned_accounts=[sa("P", "e1", "Customer"), sa("P", "e2", "Business"), sa("Q", "e2", "Business")],
        customers=[("c1", "e1")],
        businesses=[("b2", "e2")],
        accounts=[("A", "c1", None), ("B", "c1", None), ("C", None, "b2")],
        post_credit_transactions=[
            ("A", D(10), ts("1997-01-05 00:00:00")),
            ("B", D(5), ts("1997-02-05 00:00:00")),
            ("C", D(7), ts("1997-03-05 00:00:00")),
            ("A", D(100), ts("1998-01-05 00:00:00")),
            ("Q9", D(1), ts("1997-03-05 00:00:00")),
        ],
    )
    args = (t.post_credit_transactions, t.accounts, t.customers, t.businesses, YEAR)
    by_email = {r.Email: r.totalinflow for r in S.inflow(t.sales_assigned_accounts, *args, key="Email").collect()}
    # e2 has two assignment rows (P and Q): 7 counted twice
    assert by_email == {"e1": Decimal("15.00"), "e2": Decimal("14.00")}
    by_code = {r.SalesPersonCode: r.totalinflow for r in S.inflow(t.sales_assigned_accounts, *args, key="SalesPersonCode").collect()}
    assert by_code == {"P": Decimal("22.00"), "Q": Decimal("7.00")}


def test_c6_breakdown_deposit_and_rules(make_tables):
    t = make_tables(
        sales_assigned_accounts=[sa("P", "e1", "Customer")],
        transactions=[
            ("e1", "Outflow", D(100), D("53.75"), ts("1997-01-05 00:00:00")),
            ("e1", "Inflow", D(40), D(1), ts("1997-01-06 00:00:00")),
        ],
    )
    r = S.transactions_breakdown(t.transactions, YEAR, "tiered", emails=t.sales_assigned_accounts, deposit=True).first()
    assert (r.totaloutflow, r.totalfees, r.totalrevenue, r.totaldeposit) == (
        Decimal("100.00"), Decimal("53.75"), Decimal("50.0000"), Decimal("40.00"))
    flat = S.transactions_breakdown(t.transactions, YEAR, "flat").first()
    assert flat.totalrevenue == Decimal("49.9875")


def test_c7_balances_weighted_and_historic(make_tables):
    # (e1, Customer) assigned twice, two balance rows -> 4 rows; (e1, Business) balance row
    # has no Business assignment -> absent; historic form matches by e-mail only, no repeats.
    t = make_tables(
        sales_assigned_accounts=[sa("P", "e1", "Customer"), sa("Q", "e1", "Customer")],
        daily_balances=[("e1", "Customer", D(1), D(1)), ("e1", "Customer", D(2), D(2)), ("e1", "Business", D(3), D(3))],
    )
    rows = sorted(r.TotalLedgerBalance for r in S.assigned_balances(t.daily_balances, t.sales_assigned_accounts).collect())
    assert rows == [Decimal("1.00")] * 2 + [Decimal("2.00")] * 2
    w = S.balance_weights(t.daily_balances, t.sales_assigned_accounts).collect()
    assert [(r._k, r._d, r._ledger) for r in w] == [(2, 2, Decimal("3.00"))]
    p = S.assigned_accounts(t.sales_assigned_accounts, "P")
    hist = sorted(r.TotalLedgerBalance for r in S.balances_by_email(t.daily_balances, p).collect())
    assert hist == [Decimal("1.00"), Decimal("2.00"), Decimal("3.00")]


def test_catalog_reader(spark, make_tables):
    t = make_tables(sales_assigned_accounts=[sa("P", "e1", "Customer")])
    names = {}
    for name, df in t.as_dict().items():
        df.createOrReplaceTempView(f"ls_test_{name}")
        names[name] = f"ls_test_{name}"
    back = read_catalog_tables(spark, names)
    assert back.sales_assigned_accounts.count() == 1
    assert back.daily_balances.columns[-1] == "BalanceDate"
