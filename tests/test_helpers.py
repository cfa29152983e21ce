"""Small helpers: replication, windows, revenue rules, casts."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions.dates import OMITTED, DateWindow, default_window
from ledgerscope.functions.money import as_money
from ledgerscope.functions.revenue import revenue
from ledgerscope.operators.stages import replicate


def test_replicate_counts(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("c", 0), ("d", 10001)], "k string, n long")
    out = {r.k: r["count"] for r in replicate(df, "n", chunk=100).groupBy("k").count().collect()}
    assert out == {"a": 3, "b": 1, "c": 1, "d": 10001}


def test_default_window(spark):
    tx = spark.createDataFrame(
        [(dt.datetime(1996, 3, 4, 15, 0),), (dt.datetime(1997, 1, 1),)], "DateCreated timestamp_ntz"
    )
    w = default_window(tx, None, OMITTED, as_of="1998-01-01")
    assert w == DateWindow(dt.date(1996, 3, 4), dt.date(1998, 1, 1))
    assert default_window(tx, None, None, as_of="1998-01-01").end is None
    empty = tx.where(F.lit(False))
    assert default_window(empty, None, OMITTED, as_of="1998-01-01").start == dt.date(1997, 1, 1)
    assert default_window(tx, "1990-05-05", "1991-01-01").start == dt.date(1990, 5, 5)


def test_revenue_rules(spark):
    rows = [("Outflow", "10.75"), ("Outflow", "26.88"), ("Outflow", "53.75"), ("Outflow", "1.00"), ("Outflow", None), ("Inflow", "10.75"), (None, "10.75")]
    df = spark.createDataFrame(rows, "t string, fee string").select("t", as_money("fee").alias("fee"))
    flat = [r[0] for r in df.select(revenue(F.col("t"), F.col("fee"), "flat")).collect()]
    tiered = [r[0] for r in df.select(revenue(F.col("t"), F.col("fee"), "tiered")).collect()]
    assert flat == [Decimal("9.9975"), Decimal("24.9984"), Decimal("49.9875"), Decimal("0.9300"), None, 0, 0]
    assert tiered == [Decimal("10"), Decimal("25"), Decimal("50"), Decimal("0.9300"), None, 0, 0]
    with pytest.raises(ValueError):
        revenue(F.col("t"), F.col("fee"), "other")


def test_money_text_cast_strict_and_lenient(spark):
    df = spark.createDataFrame([("12.5",), ("abc",)], "a string")
    assert [r[0] for r in df.select(as_money("a", lenient=True)).collect()] == [Decimal("12.50"), None]
    with pytest.raises(Exception):
        df.select(as_money("a")).collect()


def test_scale_settings():
    from ledgerscope.config import scale_settings

    # 100 TB on 8,000 cores: one initial partition per 128 MB
    big = scale_settings(100 * 1024**4, 8000)
    assert big["spark.sql.shuffle.partitions"] == str(100 * 1024**4 // (128 << 20))
    # 10 GB on 64 cores: 80 partitions of 128 MB, at least two waves (128)
    mid = scale_settings(10 * 1024**3, 64)
    assert mid["spark.sql.shuffle.partitions"] == "128"
    assert mid["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
