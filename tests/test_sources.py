"""Table readers: conforming foreign schemas, landing layout, round trip."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest

from ledgerscope.sources.tables import conform, read_jdbc_tables, read_parquet_tables, write_tables


def test_conform_casts_text_money_strictly(spark):
    df = spark.createDataFrame(
        [("e1", "Outflow", "12.5", "0.25", dt.datetime(1997, 1, 2), "extra")],
        "emailaddress string, TRANSACTIONTYPE string, Amount string, TransactionFee string, DateCreated timestamp_ntz, junk string",
    )
    out = conform(df, "transactions")
    assert out.columns == ["EmailAddress", "TransactionType", "Amount", "TransactionFee", "DateCreated"]
    row = out.first()
    assert (row.Amount, row.TransactionFee) == (Decimal("12.50"), Decimal("0.25"))
    bad = spark.createDataFrame([("e1", "Outflow", "12,5", None, None)], "EmailAddress string, TransactionType string, Amount string, TransactionFee string, DateCreated string")
    with pytest.raises(Exception):
        conform(bad, "transactions").collect()


def test_conform_refuses_missing_columns_and_lost_decimals(spark):
    df = spark.createDataFrame([("e1", "Outflow", "1.0000001")], "EmailAddress string, TransactionType string, Amt string")
    with pytest.raises(ValueError, match="transactions has no column Amount, TransactionFee, DateCreated"):
        conform(df, "transactions")
    fine = "Beneficiary string, BeneficiaryAccountNumber string, Amount {}, RequestDate timestamp_ntz"
    for kind, value in (("string", "1.0000001"), ("decimal(20,8)", Decimal("1.00000010"))):
        bad = spark.createDataFrame([("x", "A1", value, None)], fine.format(kind))
        with pytest.raises(Exception, match="more than 6 decimals"):
            conform(bad, "post_credit_transactions").collect()
    good = spark.createDataFrame([("x", "A1", Decimal("1.00100000"), None)], fine.format("decimal(20,8)"))
    assert conform(good, "post_credit_transactions").first().Amount == Decimal("1.001")


def test_jdbc_facts_must_be_partitioned(spark):
    with pytest.raises(ValueError, match="partitioning of transactions lacks"):
        read_jdbc_tables(spark, "jdbc:none", {})


def test_conform_adds_missing_optional_column(spark):
    df = spark.createDataFrame([("e1", "Customer", Decimal("1.00"), Decimal("2.00"))],
                               "UserName string, AccountHolder string, TotalLedgerBalance decimal(10,2), TotalAvailableBalance decimal(10,2)")
    out = conform(df, "daily_balances")
    assert out.columns[-1] == "BalanceDate" and out.first().BalanceDate is None


def test_landing_layout_and_round_trip(spark, make_tables):
    t = make_tables(
        sales_assigned_accounts=[("P", "A", "e1", "n", "p", "Customer")],
        transactions=[("e1", "Outflow", Decimal("1.00"), None, dt.datetime(1997, 3, 4, 5)),
                      ("e1", "Inflow", Decimal("2.00"), None, dt.datetime(1997, 4, 1))],
        post_credit_transactions=[("A1", Decimal("3.00"), dt.datetime(1998, 1, 31, 23))],
    )
    root = tempfile.mkdtemp(prefix="ledgerscope-land-")
    write_tables(t, root)
    parts = sorted(d for d in os.listdir(os.path.join(root, "transactions")) if d.startswith("created_month="))
    assert parts == ["created_month=1997-03-01", "created_month=1997-04-01"]
    assert os.listdir(os.path.join(root, "post_credit_transactions")).count("request_month=1998-01-01") == 1
    back = read_parquet_tables(spark, root)
    assert "created_month" in back.transactions.columns
    assert back.transactions.count() == 2 and back.sales_assigned_accounts.count() == 1
    with pytest.raises(Exception):
        write_tables(t, root)  # never overwrites by default


def test_landing_splits_a_hot_key_between_writer_tasks(spark, make_tables):
    # 400 assignments of one sales person: range partitioning on the key alone
    # would put them all in one task; the row hash splits them.
    t = make_tables(sales_assigned_accounts=[("HOT", "A", f"e{i}", "n", "p", "Customer") for i in range(400)])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny data would be merged
    try:
        root = tempfile.mkdtemp(prefix="ledgerscope-hot-")
        write_tables(t, root)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for f in os.listdir(os.path.join(root, "sales_assigned_accounts")) if f.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(os.path.join(root, "sales_assigned_accounts")).count() == 400
