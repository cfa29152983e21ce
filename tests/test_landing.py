"""Incremental landing, the earliest day without a scan, and windows read through monthly roll-ups."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

import pytest
from conftest import SF_SMALL, D, ts
from test_person_plan import run, scans

from ledgerscope.functions.dates import OMITTED, DateWindow, default_window, listed_months
from ledgerscope.operators import stages as S
from ledgerscope.plans.assignment import assignment_rows
from ledgerscope.plans.salesperson import sales_person_rows
from ledgerscope.sources.fixture import fixture_tables
from ledgerscope.sources.landing import land_batch
from ledgerscope.sources.rollups import write_rollups
from ledgerscope.sources.tables import read_parquet_tables, write_tables
from ledgerscope.sources.windows import whole_months

TX = "EmailAddress string, TransactionType string, Amount decimal(20,6), TransactionFee decimal(20,6), DateCreated timestamp_ntz"


def tx(spark, *rows):
    return spark.createDataFrame([(e, "Outflow", D(a), D("1"), ts(when) if when else None) for e, a, when in rows], TX)


def files(path):
    """Every data file with its time of change."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def amounts(spark, root, name="transactions"):
    rows = spark.read.parquet(os.path.join(root, name)).select("EmailAddress", "Amount", "created_month").collect()
    return sorted((r[0], str(r[1].normalize()), str(r[2])) for r in rows)


@pytest.mark.parametrize("buckets", [0, 4])
def test_new_month_and_late_row_leave_other_directories_alone(spark, make_tables, buckets):
    root = tempfile.mkdtemp(prefix="ledgerscope-increment-")
    start = tx(spark, ("a", "1", "1997-01-05 00:00:00"), ("b", "2", "1997-02-05 00:00:00"), ("c", "3", "1997-02-06 00:00:00"), ("d", "9", None))
    write_tables(make_tables().replace(transactions=start), root, buckets=buckets)
    write_rollups(read_parquet_tables(spark, root), root)
    path = os.path.join(root, "transactions")

    before = files(path)
    assert land_batch(spark, tx(spark, ("a", "4", "1997-03-01 00:00:00")), "transactions", root) == [dt.date(1997, 3, 1)]
    after = files(path)
    assert {f: after.get(f) for f in before} == before  # untouched, to the nanosecond

    before = after
    late = tx(spark, ("b", "5", "1997-02-28 10:00:00"))
    land_batch(spark, late, "transactions", root, kind="add")
    after = files(path)
    assert all(after.get(f) == t for f, t in before.items() if "created_month=1997-02" not in f)
    want = [("a", "1", "1997-01-01"), ("a", "4", "1997-03-01"), ("b", "2", "1997-02-01"), ("b", "5", "1997-02-01"), ("c", "3", "1997-02-01"), ("d", "9", "None")]
    assert amounts(spark, root) == want
    if buckets:  # only the late row's bucket was rewritten
        changed = {os.path.dirname(f) for f in before if f not in after}
        assert len(changed) == 1

    t = read_parquet_tables(spark, root)
    month = {(r["created_month"], r["EmailAddress"]): r["totaloutflow"] for r in t.transaction_months.collect()}
    assert month[(dt.date(1997, 2, 1), "b")] == D("7") and month[(dt.date(1997, 3, 1), "a")] == D("4") and len(month) == 5


def test_replacing_a_month_is_repeatable_and_drops_stale_buckets(spark):
    root = tempfile.mkdtemp(prefix="ledgerscope-replace-")
    many = tx(spark, *((f"e{i}", "1", "1997-01-05 00:00:00") for i in range(12)), ("z", "1", "1997-02-05 00:00:00"))
    land_batch(spark, many, "transactions", root, buckets=4)
    write_rollups_to = read_facts(spark, root)
    from ledgerscope.sources.rollups import monthly

    monthly(write_rollups_to, "transaction_months").write.partitionBy("created_month", "key_bucket_of_4").parquet(os.path.join(root, "transaction_months"))
    for _ in range(2):
        land_batch(spark, tx(spark, ("e1", "7", "1997-01-09 00:00:00")), "transactions", root)
        assert amounts(spark, root) == [("e1", "7", "1997-01-01"), ("z", "1", "1997-02-01")]
        assert spark.read.parquet(os.path.join(root, "transaction_months")).count() == 2
    with pytest.raises(ValueError, match="landed with 4 buckets"):
        land_batch(spark, many, "transactions", root, buckets=8)
    with pytest.raises(ValueError, match="not a fact"):
        land_batch(spark, many, "customers", root)
    with pytest.raises(ValueError, match="kind"):
        land_batch(spark, many, "transactions", root, kind="other")
    assert land_batch(spark, many.limit(0), "transactions", root) == []


def read_facts(spark, root):
    from ledgerscope.sources.tables import conform

    return conform(spark.read.parquet(os.path.join(root, "transactions")), "transactions")


def test_months_are_listed_without_a_job(spark, make_tables):
    root = tempfile.mkdtemp(prefix="ledgerscope-first-")
    write_tables(make_tables().replace(transactions=tx(spark, ("a", "1", "1997-03-05 07:00:00"), ("b", "1", "1997-02-09 00:00:00"), ("c", "1", None))), root)
    t = read_parquet_tables(spark, root).transactions
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "months from paths")
    try:
        assert listed_months(t) == [dt.date(1997, 2, 1), dt.date(1997, 3, 1)]
        assert not tracker.getJobIdsForGroup("listing")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    first = default_window(t, None, OMITTED, as_of="1999-01-01")
    assert first == DateWindow.of("1997-02-09", "1999-01-01")
    # a listed month may hold no row: the next one counts, and after some misses all rows
    assert default_window(t.where("EmailAddress = 'a'"), None, OMITTED, as_of="1999-01-01").start == dt.date(1997, 3, 5)
    assert default_window(t.where("EmailAddress = 'c'"), None, OMITTED, as_of="1999-01-01").start == dt.date(1998, 1, 1)


@pytest.mark.parametrize(
    ("start", "end", "months"),
    [
        ("1997-01-01", "1997-03-31", ("1997-01-01", "1997-02-01")), ("1997-01-02", "1997-03-01", ("1997-02-01", "1997-02-01")),
        ("1997-01-31", "1997-02-28", None), ("1997-01-01", "1997-01-31", None), ("1996-12-05", "1997-02-01", ("1997-01-01", "1997-01-01")),
        ("1997-03-01", "1997-02-01", None), (None, "1997-02-01", None),
    ],
)
def test_whole_months(start, end, months):
    got = whole_months(DateWindow.of(start, end))
    assert got == (None if months is None else tuple(dt.date.fromisoformat(m) for m in months))


@pytest.fixture(scope="module", params=[0, 4])
def rolled(spark, request):
    t = fixture_tables(spark, SF_SMALL)
    window = DateWindow.of("1996-11-01", "1997-12-31")
    t = t.replace(
        transactions=S.in_window(t.transactions, "DateCreated", window), post_credit_transactions=S.in_window(t.post_credit_transactions, "RequestDate", window)
    )
    root = tempfile.mkdtemp(prefix="ledgerscope-rollups-")
    write_tables(t, root, buckets=request.param)
    write_rollups(read_parquet_tables(spark, root), root)
    return read_parquet_tables(spark, root)


def test_rolled_windows_equal_raw_windows(spark, rolled):
    raw = rolled.replace(transaction_months=None, credit_months=None)
    assert rolled.transaction_months is not None and rolled.credit_months is not None
    rng = random.Random(8)
    day = lambda: dt.date(1996, 11, 1) + dt.timedelta(days=rng.randrange(420))
    windows = [tuple(sorted((day(), day()))) for _ in range(3)] + [(dt.date(1997, 1, 1), dt.date(1997, 6, 1)), (dt.date(1997, 2, 10), dt.date(1997, 3, 1))]
    for w in windows:
        for make in (
            lambda t: S.transactions_breakdown(t.transactions, DateWindow(*w), "tiered", deposit=True, months=t.transaction_months),
            lambda t: S.credits_per_account(t.post_credit_transactions, DateWindow(*w), t.credit_months),
        ):
            got, want = (sorted((tuple(map(str, r)) for r in make(t).collect())) for t in (rolled, raw))
            assert [tuple(x.rstrip("0").rstrip(".") for x in r) for r in got] == [tuple(x.rstrip("0").rstrip(".") for x in r) for r in want]


def test_reports_read_through_rollups(spark, rolled):
    raw = rolled.replace(transaction_months=None, credit_months=None)
    w = DateWindow.of("1996-11-15", "1997-10-20")
    for make in (lambda t: assignment_rows(t, "SAL-0003", w), lambda t: sales_person_rows(t, w)):
        got, want = (sorted(map(tuple, make(t).collect()), key=str) for t in (rolled, raw))
        assert got == want and got


def test_inner_months_of_facts_are_not_read(spark, rolled):
    w = DateWindow.of("1996-11-15", "1997-10-20")
    edges = rolled.transactions.where("created_month IN (DATE'1996-11-01', DATE'1997-10-01')").count()
    _, found = run(S.transactions_breakdown(rolled.transactions, w, months=rolled.transaction_months))
    opened = dict(scans(found))
    assert opened["transactions"] <= edges < 0.4 * rolled.transactions.count()
    assert opened["transaction_months"] > 0
