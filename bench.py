"""Benchmark the reports; prints one JSON line.

Setup (not timed): derive the seven tables from ``$BENCH_SF_DIR`` and land
them as Parquet in a fresh scratch directory with the production layout
(facts partitioned by month, sorted by join key), then read them back the
way a deployment would.  Timed: each query, warm, median of
``$BENCH_RUNS`` runs (default 5) after a warm-up pass over all queries, written to Spark's
``noop`` sink so the whole plan executes without collecting to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from ledgerscope.config import local_session, tune
from ledgerscope.functions.dates import DateWindow
from ledgerscope.operators import stages as S
from ledgerscope.plans.assignment import assignment_summary
from ledgerscope.plans.salesperson import sales_person_summary
from ledgerscope.sources.fixture import fixture_tables
from ledgerscope.sources.rollups import write_rollups
from ledgerscope.sources.tables import read_parquet_tables, write_tables

YEAR = DateWindow.of("1997-01-01", "1997-12-31")
TWO_YEARS = DateWindow.of("1997-01-01", "1998-12-31")
THREE_YEARS = DateWindow.of("1996-01-01", "1998-12-31")
LONG = DateWindow.of("1996-03-10", "1998-09-20")


def build_queries(t):
    return {
        # assignment summary for one sales person (flat revenue), sorted by e-mail
        "assignment_summary": lambda: assignment_summary(t, "SAL-0003", YEAR),
        # same, separate credit window, caller's sort
        "assignment_review_split_windows": lambda: assignment_summary(
            t, "SAL-0003", YEAR, TWO_YEARS, ["totalOutflow", "email"], ["A", "D"]
        ),
        # summary per sales person (tiered revenue), sorted by available balance
        "sales_person_summary": lambda: sales_person_summary(
            t, YEAR, None, ["totalAvailableBalance"], ["D"]
        ),
        "sales_person_review_split_windows": lambda: sales_person_summary(t, THREE_YEARS, YEAR),
        # the two heavy stages alone
        "inflow_by_sales_person": lambda: S.inflow(
            t.sales_assigned_accounts,
            t.post_credit_transactions,
            t.accounts,
            t.customers,
            t.businesses,
            YEAR,
            key="SalesPersonCode",
        ),
        "transactions_tiered": lambda: S.transactions_breakdown(
            t.transactions, YEAR, "tiered", emails=t.sales_assigned_accounts, deposit=True
        ),
    }


def build_landed_queries(t):
    """On tables landed by month and key bucket, with monthly roll-ups."""
    return {
        "assignment_summary_bucketed": lambda: assignment_summary(t.replace(transaction_months=None, credit_months=None), "SAL-0003", YEAR),
        "assignment_summary_long_rolled": lambda: assignment_summary(t, "SAL-0003", LONG),
        "sales_person_summary_long_rolled": lambda: sales_person_summary(t, LONG),
        "sales_person_summary_long_raw": lambda: sales_person_summary(t.replace(transaction_months=None, credit_months=None), LONG),
    }


def executed(plan):
    """Physical nodes of an executed plan; reused exchanges are leaves."""
    yield plan.nodeName()
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from executed(plan.executedPlan())
    elif plan.nodeName().endswith("QueryStage"):
        yield from executed(plan.plan())
    else:
        children = plan.children()
        for i in range(0 if plan.nodeName() == "ReusedExchange" else children.size()):
            yield from executed(children.apply(i))


def plan_shape(df) -> dict[str, int]:
    """Exchanges and scans of the planned physical plan, in which every use of a relation and every pruning
    subquery has its own copy, and of the executed one, where equal exchanges run once."""
    text = str(df._jdf.queryExecution().executedPlan().toString())
    df.collect()
    nodes = list(executed(df._jdf.queryExecution().executedPlan()))
    shuffles = sum(1 for line in text.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line)
    return {
        "shuffles": shuffles,
        "broadcasts": text.count("BroadcastExchange"),
        "scans": text.count("FileScan parquet"),
        "shuffles_run": nodes.count("Exchange"),
        "scans_run": sum(n.startswith("Scan parquet") for n in nodes),
        "reused": nodes.count("ReusedExchange"),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cores=cores, shuffle_partitions=cores, app="ledgerscope-bench")
    tune(spark)

    scratch = tempfile.mkdtemp(prefix="ledgerscope-bench-")
    t0 = time.time()
    write_tables(fixture_tables(spark, sf_dir), scratch)
    land_sec = time.time() - t0
    tables = read_parquet_tables(spark, scratch)

    landed = tempfile.mkdtemp(prefix="ledgerscope-bench-buckets-")
    t0 = time.time()
    write_tables(tables, landed, buckets=4)
    write_rollups(read_parquet_tables(spark, landed), landed)
    land_buckets_sec = time.time() - t0

    queries = build_queries(tables) | build_landed_queries(read_parquet_tables(spark, landed))
    for make in queries.values():  # one warm-up pass over everything (JIT, file listing caches)
        make().write.format("noop").mode("overwrite").save()
    results, shapes = {}, {}
    for name, make in queries.items():
        shapes[name] = plan_shape(make())
        times = []
        for _ in range(runs):
            start = time.time()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        results[name] = round(statistics.median(times), 3)
        print(f"{name}: {results[name]}s", file=sys.stderr)

    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cores": cores,
                "runs": runs,
                "spark": spark.version,
                "setup_land_tables_sec": round(land_sec, 3),
                "setup_land_buckets_sec": round(land_buckets_sec, 3),
                "plan_shape": shapes,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
