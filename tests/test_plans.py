"""Plan-shape checks: the properties the reports rely on at scale."""

from __future__ import annotations

import contextlib
import io
import tempfile

import pytest
from conftest import SF_MID, SF_SMALL

from ledgerscope.functions.dates import DateWindow
from ledgerscope.operators import stages as S
from ledgerscope.plans.assignment import assignment_rows
from ledgerscope.plans.salesperson import sales_person_rows
from ledgerscope.sources.fixture import fixture_tables
from ledgerscope.sources.tables import read_parquet_tables, write_tables

YEAR = DateWindow.of("1997-01-01", "1997-12-31")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def landed(spark):
    root = tempfile.mkdtemp(prefix="ledgerscope-plans-")
    write_tables(fixture_tables(spark, SF_SMALL), root)
    return read_parquet_tables(spark, root)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_resolved_accounts_is_an_equi_join(spark, no_broadcast):
    t = fixture_tables(spark, SF_SMALL)
    p = plan(S.resolve_accounts(S.account_holders(t.sales_assigned_accounts, t.customers, t.businesses), t.accounts))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "SortMergeJoin Inner" in p


def test_reports_have_no_nested_loop_or_cartesian(spark, no_broadcast, landed):
    for df in (sales_person_rows(landed, YEAR), assignment_rows(landed, "SAL-0003", YEAR)):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_window_and_columns_reach_the_parquet_scan(landed):
    p = plan(S.transactions_breakdown(landed.transactions, YEAR, "flat"))
    scan = p[p.index("Scan parquet") :]
    assert "PushedFilters: [IsNotNull(DateCreated), GreaterThanOrEqual(DateCreated,1997-01-01T00:00)" in scan
    assert "LessThanOrEqual(DateCreated,1997-12-31T00:00)" in scan
    assert "PartitionFilters: [isnotnull(created_month" in scan
    read_schema = scan[scan.index("ReadSchema:") :].splitlines()[0]
    assert "DateCreated" in read_schema and "EmailAddress" in read_schema
    assert "created_month" not in read_schema  # partition column: pruned by directory, not read


def test_credit_window_reaches_the_scan(landed):
    p = plan(S.credits_per_account(landed.post_credit_transactions, YEAR))
    assert "GreaterThanOrEqual(RequestDate,1997-01-01T00:00)" in p
    assert "PartitionFilters: [isnotnull(request_month" in p


def test_large_email_set_filters_after_partial_aggregation(landed):
    p = plan(S.transactions_breakdown(landed.transactions, YEAR, "flat", emails=landed.sales_assigned_accounts))
    # the fact is aggregated (partial, map-side) before it meets the e-mail set;
    # Catalyst must not have turned the filter into a semi join on raw rows
    assert "LeftSemi" not in p
    assert "partial_sum" in p


def test_sales_person_summary_never_replicates_rows(landed):
    # repeated balance rows are weights, not generated rows (the only Generate
    # is the account-owner inline, at most two rows per account)
    p = plan(sales_person_rows(landed, YEAR))
    assert "sequence(" not in p
    assert "sequence(" in plan(assignment_rows(landed, "SAL-0003", YEAR))


def test_person_filter_pushed_to_scan(landed):
    p = plan(S.assigned_accounts(landed.sales_assigned_accounts, "SAL-0003"))
    assert "EqualTo(SalesPersonCode,SAL-0003)" in p


@pytest.fixture(scope="module")
def bucketed(spark):
    """One year of facts, landed by month and key bucket."""
    t = fixture_tables(spark, SF_MID)
    year = {
        "transactions": S.in_window(t.transactions, "DateCreated", YEAR),
        "post_credit_transactions": S.in_window(t.post_credit_transactions, "RequestDate", YEAR).limit(2000),
    }
    root = tempfile.mkdtemp(prefix="ledgerscope-buckets-")
    write_tables(t.replace(**year), root, buckets=128)
    return read_parquet_tables(spark, root)


def test_one_person_prunes_buckets_of_both_facts(bucketed):
    p = plan(assignment_rows(bucketed, "SAL-0003", YEAR))
    facts = [b for b in p.split("\n\n") if "Scan parquet" in b and "transactions]" in b]
    assert len(facts) == 2
    assert all("dynamicpruning" in b and "key_bucket_of_128" in b for b in facts)


def test_one_person_reads_a_small_share_of_the_facts(spark, bucketed):
    code = S.assigned_accounts(bucketed.sales_assigned_accounts, "SAL-0003")
    want = sorted(r["Email"] for r in code.where("Email is not null").select("Email").distinct().collect())[:5]  # few among many
    some = spark.createDataFrame([(e,) for e in want], "Email string")
    rows = S.with_keys(bucketed.transactions, "EmailAddress", some).collect()
    everything = bucketed.transactions.collect()
    assert sorted(map(str, rows)) == sorted(str(r) for r in everything if r["EmailAddress"] in want)
    buckets = {r["key_bucket_of_128"] for r in rows}
    in_buckets = sum(r["key_bucket_of_128"] in buckets for r in everything)
    assert in_buckets < 0.1 * len(everything)  # all that the pruned scan opens


def test_building_the_report_runs_no_job(spark, landed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "plan building")
    try:
        assignment_rows(landed, "SAL-0003", YEAR)
        assert not tracker.getJobIdsForGroup("build-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sales_person_summary_scans_assignments_once(landed, no_broadcast):
    p = plan(sales_person_rows(landed, YEAR))
    assert sum("Scan parquet" in b and "sales_assigned_accounts]" in b for b in p.split("\n\n")) == 1


@pytest.mark.parametrize("name", sorted(__import__("__spark_entry__")._QUERIES))
def test_no_query_uses_pairs_or_python(spark, no_broadcast, name):
    # Every registered query: no Cartesian product or nested-loop join (pairs),
    # no Python UDF evaluation (everything stays in the JVM).
    import __spark_entry__ as E

    p = plan(E._QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, f"{name} plans {bad}"


def test_default_window_on_landed_facts_reads_one_month(spark, landed):
    from ledgerscope.functions.dates import OMITTED, default_window

    got = default_window(landed.transactions, None, OMITTED, as_of="1999-01-01")
    want = default_window(fixture_tables(spark, SF_SMALL).transactions, None, OMITTED, as_of="1999-01-01")
    assert got == want
