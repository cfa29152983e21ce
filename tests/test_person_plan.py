"""The one-person report's plan: every table scanned once, one key relation, bucket pruning, hot pairs split by size."""

from __future__ import annotations

import tempfile

import pytest
from conftest import SF_MID, D, ts
from pyspark.sql import functions as F
from test_plans import plan

from ledgerscope.config import tune
from ledgerscope.functions.dates import DateWindow
from ledgerscope.operators import stages as S
from ledgerscope.plans.assignment import assignment_rows, rows_with_measures
from ledgerscope.schemas import TABLE_NAMES
from ledgerscope.sources.fixture import fixture_tables
from ledgerscope.sources.tables import read_parquet_tables, write_tables

YEAR = DateWindow.of("1997-01-01", "1997-12-31")
BUCKETS = 512
PERSON = "SAL-0003"


def nodes(plan):
    """All physical nodes of an executed plan, those of reused exchanges left out."""
    name = plan.nodeName()
    yield plan
    if name == "AdaptiveSparkPlan":
        yield from nodes(plan.executedPlan())
    elif name.endswith("QueryStage"):
        yield from nodes(plan.plan())
    elif name != "ReusedExchange":
        children = plan.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))


def run(df):
    rows = df.collect()
    return rows, list(nodes(df._jdf.queryExecution().executedPlan()))


def scans(found) -> list[tuple[str, int]]:
    """(files' table directory, rows put out) of each scan."""
    out = []
    for node in found:
        if node.nodeName().startswith("Scan parquet"):
            root = node.relation().location().rootPaths().apply(0).toString()
            out.append((root.rstrip("/").rsplit("/", 1)[-1], int(node.metrics().apply("numOutputRows").value())))
    return out


@pytest.fixture(scope="module")
def landed(spark):
    root = tempfile.mkdtemp(prefix="ledgerscope-person-")
    write_tables(fixture_tables(spark, SF_MID), root)
    return read_parquet_tables(spark, root)


@pytest.fixture(scope="module")
def bucketed(spark):
    """A week of facts, and all dimensions, by key bucket."""
    t = fixture_tables(spark, SF_MID)
    window = DateWindow.of("1997-03-01", "1997-03-08")
    facts = {
        "transactions": S.in_window(t.transactions, "DateCreated", window),
        "post_credit_transactions": S.in_window(t.post_credit_transactions, "RequestDate", window),
    }
    root = tempfile.mkdtemp(prefix="ledgerscope-person-buckets-")
    write_tables(t.replace(**facts), root, buckets=BUCKETS)
    return read_parquet_tables(spark, root)


def test_every_table_is_scanned_once(spark, landed):
    _, found = run(assignment_rows(landed, PERSON, YEAR))
    tables = sorted(t for t, _ in scans(found))
    assert tables == sorted([*TABLE_NAMES, "sales_assigned_accounts"])  # assignments: pairs, and whole rows at the end
    assert sum(n.nodeName() == "ReusedExchange" for n in found) >= 2
    assert sum(n.nodeName() == "Exchange" for n in found) <= 9


def test_key_relation_is_shared_without_broadcasts_too(spark, landed):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, found = run(assignment_rows(landed, PERSON, YEAR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    tables = [t for t, _ in scans(found)]
    for name in ("accounts", "customers", "businesses", "transactions", "post_credit_transactions", "daily_balances"):
        assert tables.count(name) == 1
    assert sum(n.nodeName() == "ReusedExchange" for n in found) >= 1


def test_one_person_opens_a_small_share_of_every_table(spark, bucketed):
    """Credits are pruned by the accounts found, where they outweigh these (``test_plans``); a week of them does not."""
    tune(spark)
    few = bucketed.sales_assigned_accounts.where(F.col("SalesPersonCode") == PERSON).orderBy("Email").limit(20).collect()
    person = spark.createDataFrame([(*r[:0], "FEW", *r[1:]) for r in few], bucketed.sales_assigned_accounts.schema)
    root = tempfile.mkdtemp(prefix="ledgerscope-few-")
    person.write.mode("overwrite").parquet(root)
    t = bucketed.replace(sales_assigned_accounts=spark.read.parquet(root))
    # Parts that turn out empty would leave the executed plan, and their scans with them.
    spark.conf.set("spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation")
    try:
        _, found = run(assignment_rows(t, "FEW", YEAR))
    finally:
        spark.conf.unset("spark.sql.adaptive.optimizer.excludedRules")
    opened = dict(scans(found))
    assert len(opened) >= 7
    whole = {"customers": t.customers, "businesses": t.businesses, "account_owners": t.account_owners, "daily_balances": t.daily_balances, "transactions": t.transactions}
    for name, df in whole.items():
        assert opened[name] < 0.1 * df.count(), name
        assert sum(t == name for t, _ in scans(found)) == 1, name
    blocks = [b for b in plan(assignment_rows(t, "FEW", YEAR)).split("\n\n") if "Scan parquet" in b]
    for name in whole:
        assert any("dynamicpruning" in b for b in blocks if f"/{name}]" in b), name


def test_buckets_do_not_change_the_report(spark, bucketed):
    window = DateWindow.of("1997-03-02", "1997-03-05")
    plain = {name: df.drop(f"key_bucket_of_{BUCKETS}") for name, df in bucketed.as_dict().items()}
    whole = bucketed.replace(**plain)
    assert whole.account_owners is None
    for match in ("holder", "email"):
        got, want = (sorted(map(tuple, assignment_rows(t, PERSON, window, YEAR, balance_match=match).collect()), key=str) for t in (bucketed, whole))
        assert got == want and any(r[5] for r in got)


@pytest.mark.parametrize(("k", "copies"), [(1, 1), (500, 1), (501, 2), (10_000_000, 20_000)])
def test_pairs_are_copied_by_their_size(spark, k, copies):
    assigned = spark.createDataFrame([("a@x", "n", "p", "Customer")], "Email string, AccountName string, PhoneNumber string, AccountHolder string")
    measures = spark.createDataFrame([("a@x", "Customer", k, 5)], "Email string, AccountHolder string, _k long, m int")
    plan = rows_with_measures(assigned, measures)
    generated = [n for n in run(plan)[1] if n.nodeName() == "Generate"]
    assert int(generated[0].metrics().apply("numOutputRows").value()) == copies


def test_hot_pair_is_split_and_whole(spark, make_tables):
    """A pair of two thirds of the rows: its rows spread over copies, each row appears once with its measures."""
    people = [("P", "Ann", "hot@x", f"n{i}", "p", "Customer") for i in range(4000)] + [("P", "Ann", f"e{i}@x", "n", "p", None) for i in range(1000)]
    people += [("P", "Ann", None, f"none{i}", "p", "Customer") for i in range(1000)]
    t = make_tables(
        sales_assigned_accounts=people,
        transactions=[("hot@x", "Outflow", D("2"), D("1"), ts("1997-05-01 00:00:00")), ("e7@x", "Outflow", D("3"), D("1"), ts("1997-05-01 00:00:00"))],
    )
    rows = assignment_rows(t, "P", YEAR)
    got = rows.groupBy("email").agg(F.count("*").alias("n"), F.sum("totaloutflow").alias("s"), F.countDistinct("accountname").alias("names")).collect()
    found = {r["email"]: (r["n"], r["s"], r["names"]) for r in got}
    assert found["hot@x"] == (4000, D("8000"), 4000) and found[None] == (1000, 0, 1000)
    assert found["e7@x"] == (1, 3, 1) and len(found) == 1002
