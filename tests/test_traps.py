"""One test per row-multiplication, null, date or sort trap of the reports.

Each builds a handful of rows by hand; the expected numbers are worked out
in the comments.  Window for all: 1997-01-01 .. 1997-12-31 unless stated.
"""

from __future__ import annotations

from decimal import Decimal

from conftest import D, ts

from pyspark.sql import functions as F

from ledgerscope.operators import stages as S
from ledgerscope.plans.assignment import assignment_rows, assignment_summary
from ledgerscope.plans.salesperson import sales_person_summary

YEAR = ("1997-01-01", "1997-12-31")


def saa(code, to, email, holder, name="n", phone="p"):
    return (code, to, email, name, phone, holder)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def base(make_tables, **extra):
    """Person P: e1 (customer c1, account A1), e2 (customer c2, account A2)."""
    rows = dict(
        sales_assigned_accounts=[saa("P", "Ann", "e1", "Customer"), saa("P", "Ann", "e2", "Customer")],
        customers=[("c1", "e1"), ("c2", "e2")],
        accounts=[("A1", "c1", None), ("A2", "c2", None)],
        post_credit_transactions=[("A1", D(100), ts("1997-03-01 10:00:00"))],
    )
    rows.update(extra)
    return make_tables(**rows)


def test_t1_person_inflow_repeats_per_joined_row(make_tables):
    # inflow(P) = 100; the group has 2 joined rows (no balances) -> 2 x 100.
    t = base(make_tables)
    r = by(sales_person_summary(t, YEAR), "salespersoncode")["P"]
    assert r["totalinflow"] == Decimal("200.00")
    assert r["totalnumberofaccounts"] == 2


def test_t2_every_balance_row_counts(make_tables):
    # e1 has 3 balance rows (10, 20, 30), assigned once: R1 shows 3 rows for e1.
    # R2: e1 contributes 3 joined rows, e2 one -> count 4, ledger 60,
    # inflow 100 x 4 = 400, outflow of e1 (5) x 3 = 15.
    t = base(
        make_tables,
        daily_balances=[("e1", "Customer", D(10), D(1)), ("e1", "Customer", D(20), D(2)), ("e1", "Customer", D(30), D(3))],
        transactions=[("e1", "Outflow", D(5), D(1), ts("1997-05-01 00:00:00"))],
    )
    r1 = assignment_summary(t, "P", YEAR).collect()
    assert sorted((r.email, r.totalledgerbalance) for r in r1) == [
        ("e1", Decimal("10.00")),
        ("e1", Decimal("20.00")),
        ("e1", Decimal("30.00")),
        ("e2", Decimal("0.00")),
    ]
    r = by(sales_person_summary(t, YEAR), "salespersoncode")["P"]
    assert r["totalnumberofaccounts"] == 4
    assert r["totalledgerbalance"] == Decimal("60.00")
    assert r["totalinflow"] == Decimal("400.00")
    assert r["totaloutflow"] == Decimal("15.00")


def test_t3_balances_joined_to_assignments_twice(make_tables):
    # e1 assigned twice to P and once to Q, one balance row (ledger 10).
    # R2 (all assignments, k = 3): each e1 row joins 3 balance copies.
    #   P: 2 rows x 3 = 6 joined rows, ledger 6 x 10 = 60; Q: 3 rows, ledger 30.
    # R1 for P (k counts only P's rows, k = 2): 2 rows x 2 copies = 4 rows.
    t = make_tables(
        sales_assigned_accounts=[
            saa("P", "Ann", "e1", "Customer"),
            saa("P", "Ann", "e1", "Customer", name="other"),
            saa("Q", "Bob", "e1", "Customer"),
        ],
        daily_balances=[("e1", "Customer", D(10), D(9))],
    )
    r2 = by(sales_person_summary(t, YEAR), "salespersoncode")
    assert r2["P"]["totalnumberofaccounts"] == 6 and r2["P"]["totalledgerbalance"] == Decimal("60.00")
    assert r2["Q"]["totalnumberofaccounts"] == 3 and r2["Q"]["totalledgerbalance"] == Decimal("30.00")
    r1 = assignment_summary(t, "P", YEAR).collect()
    assert len(r1) == 4 and all(r.totalledgerbalance == Decimal("10.00") for r in r1)


def test_t4_transactions_join_by_email_only(make_tables):
    # e held as Customer and Business by P: both rows carry e's outflow 7; R2 sums 14.
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer"), saa("P", "Ann", "e", "Business")],
        transactions=[("e", "Outflow", D(7), D(1), ts("1997-02-02 00:00:00"))],
    )
    r1 = assignment_summary(t, "P", YEAR).collect()
    assert [r.totaloutflow for r in r1] == [Decimal("7.00")] * 2
    assert by(sales_person_summary(t, YEAR), "salespersoncode")["P"]["totaloutflow"] == Decimal("14.00")


def test_t5_end_day_counts_only_at_midnight(make_tables):
    # 1997-12-31 00:00:00 is inside, 00:00:01 is not: outflow 1 only.
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer")],
        transactions=[
            ("e", "Outflow", D(1), D(0), ts("1997-12-31 00:00:00")),
            ("e", "Outflow", D(2), D(0), ts("1997-12-31 00:00:01")),
        ],
    )
    assert assignment_summary(t, "P", YEAR).first().totaloutflow == Decimal("1.00")


def test_t6_two_revenue_rules(make_tables):
    # fee 10.75 on an outflow: flat 10.75 x 0.93 = 9.9975, tiered 10.
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer")],
        transactions=[("e", "Outflow", D(1), D("10.75"), ts("1997-02-02 00:00:00"))],
    )
    assert assignment_summary(t, "P", YEAR).first().totalrevenue == Decimal("9.9975")
    assert by(sales_person_summary(t, YEAR), "salespersoncode")["P"]["totalrevenue"] == Decimal("10.0000")


def test_t7_null_fee_yields_null_revenue_skipped_by_sum(make_tables):
    # Alone: revenue and fees sum to null -> 0 after coalesce.
    # With a 26.88 fee beside it: fees 26.88, tiered revenue 25.
    only_null = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer")],
        transactions=[("e", "Outflow", D(3), None, ts("1997-02-02 00:00:00"))],
    )
    row = assignment_summary(only_null, "P", YEAR).first()
    assert (row.totalfees, row.totalrevenue, row.totaloutflow) == (Decimal("0.00"), Decimal("0.0000"), Decimal("3.00"))
    mixed = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer")],
        transactions=[
            ("e", "Outflow", D(3), None, ts("1997-02-02 00:00:00")),
            ("e", "Outflow", D(4), D("26.88"), ts("1997-02-03 00:00:00")),
        ],
    )
    r = by(sales_person_summary(mixed, YEAR), "salespersoncode")["P"]
    assert (r["totalfees"], r["totalrevenue"]) == (Decimal("26.88"), Decimal("25.0000"))


def test_t8_unknown_or_null_type_counts_zero(make_tables):
    from ledgerscope.functions.dates import DateWindow

    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer")],
        transactions=[
            ("e", None, D(3), D(1), ts("1997-02-02 00:00:00")),
            ("e", "Reversal", D(4), D(1), ts("1997-02-03 00:00:00")),
        ],
    )
    flows = S.transactions_breakdown(t.transactions, DateWindow.of(*YEAR), "tiered", emails=t.sales_assigned_accounts).collect()
    assert len(flows) == 1
    f = flows[0]
    assert (f.totaloutflow, f.totalfees, f.totalrevenue) == (Decimal("0.00"), Decimal("0.00"), Decimal("0.0000"))


def test_t9_unassigned_emails_dropped(make_tables):
    from ledgerscope.functions.dates import DateWindow

    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer")],
        transactions=[
            ("e", "Outflow", D(3), D(1), ts("1997-02-02 00:00:00")),
            ("x", "Outflow", D(4), D(1), ts("1997-02-03 00:00:00")),
        ],
    )
    window, emails = DateWindow.of(*YEAR), t.sales_assigned_accounts
    after = S.transactions_breakdown(t.transactions, window, "flat", emails=emails)
    before = S.transactions_breakdown(S.with_keys(t.transactions, "EmailAddress", emails.select("Email")), window, "flat")
    for rows in (after.collect(), before.collect()):
        assert [r.EmailAddress for r in rows] == ["e"]


def test_t10_counts_per_code_shown_on_every_assignee(make_tables):
    # P has assignees Ann (1 customer) and Cat (1 business): both rows show 1 business, 1 customer.
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e1", "Customer"), saa("P", "Cat", "e2", "Business")],
    )
    rows = sales_person_summary(t, YEAR).collect()
    assert sorted((r.assignedto, r.numberofbusiness, r.numberofcustomers) for r in rows) == [
        ("Ann", 1, 1),
        ("Cat", 1, 1),
    ]


def test_t11_account_total_need_not_match_counts(make_tables):
    # e1 with two balance rows: totalnumberofaccounts 2, customers 1.
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e1", "Customer")],
        daily_balances=[("e1", "Customer", D(1), D(1)), ("e1", "Customer", D(2), D(2))],
    )
    r = sales_person_summary(t, YEAR).first()
    assert (r.totalnumberofaccounts, r.numberofcustomers + r.numberofbusiness) == (2, 1)


def test_t12_null_code_groups(make_tables):
    # Two unassigned rows with different (null vs "X") assignees -> two null-code groups;
    # counts and inflow are 0 because "=" never matches null.
    t = base(
        make_tables,
        sales_assigned_accounts=[
            saa(None, None, "e1", "Customer"),
            saa(None, "X", "e2", "Customer"),
        ],
    )
    rows = sales_person_summary(t, YEAR).collect()
    assert sorted((r.assignedto or "", r.numberofcustomers, r.totalinflow) for r in rows) == [
        ("", 0, Decimal("0.00")),
        ("X", 0, Decimal("0.00")),
    ]
    assert all(r.salespersoncode is None for r in rows)


def test_t13_one_email_pools_inflow(make_tables):
    # e as Customer (account A1: 100) and Business (account B1: 50): both R1 rows show 150.
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e", "Customer"), saa("P", "Ann", "e", "Business")],
        customers=[("c1", "e")],
        businesses=[("b1", "e")],
        accounts=[("A1", "c1", None), ("B1", None, "b1")],
        post_credit_transactions=[("A1", D(100), ts("1997-03-01 00:00:00")), ("B1", D(50), ts("1997-03-02 00:00:00"))],
    )
    rows = assignment_summary(t, "P", YEAR).collect()
    assert [r.totalinflow for r in rows] == [Decimal("150.00")] * 2


def test_t14_duplicate_user_name_doubles_inflow(make_tables):
    # Two customer records with user name e1 (same id): A1's 100 counts twice.
    t = base(make_tables, customers=[("c1", "e1"), ("c1", "e1"), ("c2", "e2")])
    rows = by(assignment_summary(t, "P", YEAR), "email")
    assert rows["e1"]["totalinflow"] == Decimal("200.00")
    r2 = by(sales_person_summary(t, YEAR), "salespersoncode")["P"]
    assert r2["totalinflow"] == Decimal("400.00")  # 200 x 2 joined rows


def test_t15_inactive_accounts_kept(make_tables):
    t = base(make_tables)
    rows = by(assignment_summary(t, "P", YEAR), "email")
    assert set(rows) == {"e1", "e2"}
    assert rows["e2"]["totaloutflow"] == Decimal("0.00") and rows["e2"]["totalledgerbalance"] == Decimal("0.00")


def test_t16_separate_windows(make_tables):
    # Credit in 1998 counts only with a credit window reaching 1998.
    t = base(
        make_tables,
        post_credit_transactions=[("A1", D(100), ts("1998-03-01 00:00:00"))],
    )
    one = by(assignment_summary(t, "P", YEAR), "email")["e1"]["totalinflow"]
    two = by(assignment_summary(t, "P", YEAR, ("1997-01-01", "1998-12-31")), "email")["e1"]["totalinflow"]
    assert (one, two) == (Decimal("0.00"), Decimal("100.00"))


def test_null_window_keeps_rows_with_zero_flows(make_tables):
    t = base(make_tables, transactions=[("e1", "Outflow", D(5), D(1), ts("1997-05-01 00:00:00"))])
    rows = assignment_summary(t, "P", (None, "1997-12-31")).collect()
    assert len(rows) == 2 and all(r.totaloutflow == 0 and r.totalinflow == 0 for r in rows)


def test_null_code_selects_nothing(make_tables):
    t = base(make_tables)
    assert assignment_summary(t, None, YEAR).count() == 0


def test_null_holder_not_counted(make_tables):
    # COUNT(AccountHolder) skips the null-holder row; it still forms part of the group.
    t = make_tables(sales_assigned_accounts=[saa("P", "Ann", "e1", None), saa("P", "Ann", "e2", "Customer")])
    r = sales_person_summary(t, YEAR).first()
    assert (r.totalnumberofaccounts, r.numberofcustomers, r.numberofbusiness) == (1, 1, 0)


def test_hot_pair_is_weighted_not_materialised(make_tables):
    # One (e-mail, holder) assigned 3000 times to P with 10 balance rows of ledger 1.
    # Literal joins would build 3000 x (3000 x 10) = 90,000,000 rows; the report must
    # give count 9e7 and ledger 3000 x 3000 x 10 x 1 = 9e7 without building them.
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "hot", "Customer", name=f"n{i}") for i in range(3000)],
        daily_balances=[("hot", "Customer", D(1), D(2))] * 10,
        transactions=[("hot", "Outflow", D("0.01"), D(0), ts("1997-05-01 00:00:00"))],
    )
    r = sales_person_summary(t, YEAR).first()
    assert r.totalnumberofaccounts == 90_000_000
    assert r.totalledgerbalance == Decimal("90000000.00")
    assert r.totalavailablebalance == Decimal("180000000.00")
    assert r.totaloutflow == Decimal("900000.00")  # 0.01 x 9e7 joined rows


def test_hot_and_null_emails_are_split(spark, make_tables):
    # A third of the rows share one e-mail, a third have none: no join task gets a whole group.
    n = 6000
    emails = ["hot"] * (n // 3) + [None] * (n // 3) + [f"e{i}" for i in range(n // 3)]
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", e, "Customer", name=f"n{i}") for i, e in enumerate(emails)],
        transactions=[("hot", "Outflow", D("2"), D("1"), ts("1997-05-01 00:00:00"))],
    )
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("-1", "false"), strict=True):  # tiny partitions would be merged
        spark.conf.set(k, v)
    try:
        rows = assignment_rows(t, "P", YEAR)
        assert rows.count() == n
        assert rows.where("email = 'hot' and totaloutflow = 2").count() == n // 3
        assert rows.where("email is null and totaloutflow = 0").count() == n // 3
        parts = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.when(F.col("email") == "hot", 1).otherwise(0)).alias("n")).collect()]
        assert max(parts) < n // 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_money_is_summed_unrounded(make_tables):
    day = ts("1997-05-01 00:00:00")
    t = make_tables(
        sales_assigned_accounts=[saa("P", "Ann", "e1", "Customer")],
        transactions=[("e1", "Outflow", D("1.004"), D("10.754"), day)] * 3,
    )
    r1, r2 = assignment_summary(t, "P", YEAR).first(), sales_person_summary(t, YEAR).first()
    for r in (r1, r2):  # 10.754 is not the 10.75 tier
        assert (r.totaloutflow, r.totalfees, r.totalrevenue) == (Decimal("3.012"), Decimal("32.262"), Decimal("30.00366"))
