"""The command line runs both reports over landed tables."""

from __future__ import annotations

import os
import tempfile

import pytest
from conftest import SF_SMALL

from ledgerscope.__main__ import main
from ledgerscope.sources.fixture import fixture_tables
from ledgerscope.sources.tables import read_parquet_tables, stored_bytes, write_tables


def test_cli_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="ledgerscope-cli-")
    tables = os.path.join(base, "tables")
    assert main(["land-fixture", "--sf-dir", SF_SMALL, "--out", tables]) == 0
    r1 = os.path.join(base, "r1")
    assert main(["assignment-summary", "--tables", tables, "--code", "SAL-0003", "--start", "1997-01-01",
                 "--end", "1997-12-31", "--sort", "totalOutflow:A", "--sort", "email", "--out", r1]) == 0
    assert spark.read.parquet(r1).count() == 2
    r2 = os.path.join(base, "r2")
    assert main(["sales-person-summary", "--tables", tables, "--start", "1997-01-01", "--end", "1997-12-31",
                 "--out", r2, "--format", "csv", "--size-shuffles"]) == 0
    from ledgerscope.config import scale_settings

    for key in scale_settings(1, 1):  # restore the session for the tests that follow
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert spark.read.option("header", True).csv(r2).count() > 0
    # only --credit-end given: credits run from --start to 1998-12-31
    split = os.path.join(base, "split")
    assert main(["assignment-summary", "--tables", tables, "--code", "SAL-0003", "--start", "1997-01-01",
                 "--end", "1997-12-31", "--credit-end", "1998-12-31", "--out", split]) == 0
    narrow = {r.email: r.totalinflow for r in spark.read.parquet(r1).collect()}
    wide = {r.email: r.totalinflow for r in spark.read.parquet(split).collect()}
    assert all(wide[e] >= narrow[e] for e in narrow) and sum(wide.values()) > sum(narrow.values())
    dev = os.path.join(base, "dev")
    assert main(["assignment-summary", "--tables", tables, "--code", "SAL-0003", "--as-of", "1997-06-30", "--out", dev]) == 0
    assert spark.read.parquet(dev).count() == 2


def test_cli_defaults_and_usage(spark, capsys):
    base = tempfile.mkdtemp(prefix="ledgerscope-cli-")
    tables = os.path.join(base, "tables")
    assert main(["land-fixture", "--sf-dir", SF_SMALL, "--out", tables]) == 0
    report = ["assignment-summary", "--tables", tables, "--code", "SAL-0003"]
    runs = {
        "full": ["--start", "1995-01-01", "--end", "2001-12-31"],
        "no-end": ["--start", "1995-01-01"],
        "no-start": ["--end", "2001-12-31", "--credit-start", "1995-01-01"],
        "credit-only": ["--credit-start", "1995-01-01"],
    }
    flows = {}
    for name, args in runs.items():
        out = os.path.join(base, name)
        assert main([*report, *args, "--out", out]) == 0
        flows[name] = sorted((r.email, r.totaloutflow, r.totalinflow) for r in spark.read.parquet(out).collect())
    assert all(f == flows["full"] for f in flows.values()) and any(r[1] > 0 for r in flows["full"])
    for bad in ([*report, "--start", "1997-01-01"], [*report, "--historic", "--out", "x"], [*report, "--historic", "--end", "1997-01-01", "--out", "x"],
                ["sales-person-summary", "--tables", tables, "--out", "x"], ["sales-person-summary", "--tables", tables, "--start", "1997-01-01", "--out", "x"]):
        with pytest.raises(SystemExit) as e:
            main(bad)
        assert e.value.code == 2
    assert main([*report, *runs["full"], "--preview", "1"]) == 0
    assert "preview: at most 1 rows" in capsys.readouterr().out


def test_land_copies_into_buckets(spark):
    base = tempfile.mkdtemp(prefix="ledgerscope-land-")
    first, second = os.path.join(base, "a"), os.path.join(base, "b")
    small = fixture_tables(spark, SF_SMALL)
    small = small.replace(transactions=small.transactions.limit(40), post_credit_transactions=small.post_credit_transactions.limit(40))
    write_tables(small, first)
    assert main(["land", "--tables", first, "--out", second, "--buckets", "4"]) == 0
    copy = read_parquet_tables(spark, second)
    assert copy.transactions.count() == 40 and "key_bucket_of_4" in copy.transactions.columns
    assert stored_bytes(spark, [os.path.join(second, "transactions")]) > 0


def test_land_rollups_and_batch(spark, capsys):
    base = tempfile.mkdtemp(prefix="ledgerscope-batch-")
    out, batch = os.path.join(base, "out"), os.path.join(base, "batch")
    t = fixture_tables(spark, SF_SMALL)
    march = t.transactions.where("DateCreated >= '1997-03-01' AND DateCreated < '1997-04-01'")
    april = t.transactions.where("DateCreated >= '1997-04-01' AND DateCreated < '1997-05-01'")
    source = os.path.join(base, "source")
    write_tables(t.replace(transactions=march, post_credit_transactions=t.post_credit_transactions.limit(50)), source)
    assert main(["land", "--tables", source, "--out", out, "--buckets", "2", "--rollups"]) == 0
    april.write.parquet(batch)
    for _ in range(2):  # a month sent again replaces itself
        assert main(["land-batch", "--fact", "transactions", "--batch", batch, "--out", out]) == 0
    assert "landed transactions of 1997-04-01" in capsys.readouterr().out
    back = read_parquet_tables(spark, out)
    assert back.transactions.count() == march.count() + april.count()
    months = {r[0]: r[1] for r in back.transaction_months.groupBy("created_month").count().collect()}
    assert len(months) == 2 and sum(months.values()) == back.transactions.select("created_month", "EmailAddress").distinct().count()
