"""Caller-chosen sort order (FIXTURES.md §4)."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import D

from ledgerscope.plans.assignment import assignment_summary
from ledgerscope.plans.ordering import order_result, sort_columns, with_position
from ledgerscope.plans.salesperson import sales_person_summary

YEAR = ("1997-01-01", "1997-12-31")


@pytest.fixture
def people(spark):
    rows = [("b", Decimal("2.00")), ("a", Decimal("1.00")), ("c", Decimal("1.00")), (None, Decimal("3.00")), ("d", None)]
    return spark.createDataFrame(rows, "email string, totaloutflow decimal(38,2)")


def order(df):
    return [tuple(r) for r in df.collect()]


def test_not_given_leaves_default(people):
    assert order(order_result(people, None, None, default=[people.email.asc_nulls_last()]))[0][0] == "a"
    assert sort_columns(people.columns, None, ["A"]) is None
    assert sort_columns(people.columns, ["email"], None) is None
    assert sort_columns(people.columns, [], []) is None


def test_ascending_then_descending(people):
    out = order(order_result(people, ["totalOutflow", "email"], ["A", "D"]))
    # outflow ascending, nulls last; ties (1.00) by e-mail descending
    assert [r[0] for r in out] == ["c", "a", "b", None, "d"]


def test_only_exact_A_ascends(people):
    out = order(order_result(people, ["totaloutflow"], ["a"]))
    # descending, nulls first
    assert out[0] == ("d", None) and out[1] == (None, Decimal("3.00"))


def test_missing_direction_is_descending(people):
    # fields (totaloutflow, email) with directions (A): the second key descends
    out = order(order_result(people, ["totaloutflow", "email"], ["A"]))
    assert [r[0] for r in out] == ["c", "a", "b", None, "d"]


def test_extra_direction_ignored(people):
    out = order(order_result(people, ["email"], ["A", "A"]))
    assert [r[0] for r in out] == ["a", "b", "c", "d", None]


def test_unknown_field_errors(people):
    with pytest.raises(ValueError, match="sortable columns: email, totaloutflow"):
        order_result(people, ["nosuch"], ["A"])


def test_nullable_key_descending_puts_nulls_first(people):
    out = order(order_result(people, ["email"], ["D"]))
    assert out[0][0] is None and [r[0] for r in out[1:]] == ["d", "c", "b", "a"]


def test_reports_sort(make_tables):
    t = make_tables(
        sales_assigned_accounts=[
            ("P", "Ann", "e2", "n", "p", "Customer"),
            ("P", "Ann", "e1", "n", "p", "Customer"),
            (None, "X", "e3", "n", "p", "Customer"),
        ],
        daily_balances=[("e1", "Customer", D(5), D(5)), ("e3", "Customer", D(9), D(9))],
    )
    assert [r.email for r in assignment_summary(t, "P", YEAR).collect()] == ["e1", "e2"]
    assert [r.email for r in assignment_summary(t, "P", YEAR, None, ["totalLedgerBalance"], ["D"]).collect()] == [
        "e1",
        "e2",
    ]
    codes = [r.salespersoncode for r in sales_person_summary(t, YEAR, None, ["salespersoncode"], ["A"]).collect()]
    assert codes == ["P", None]
    codes = [r.salespersoncode for r in sales_person_summary(t, YEAR, None, ["salespersoncode"], ["D"]).collect()]
    assert codes == [None, "P"]


def test_with_position_numbers_rows_in_order(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("id", "(id * 7919) % 1000 AS k")
    out = with_position(df.repartition(5), [df.k.desc_nulls_first(), df.id.asc_nulls_last()])
    rows = sorted(out.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 1001))
    assert [r.k for r in rows] == sorted((r.k for r in rows), reverse=True)
