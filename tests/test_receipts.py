"""Receipt ingest with the declared schema (invented receipts, not the sample's values)."""

from __future__ import annotations

import json
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.schemas import RECEIPT
from ledgerscope.sources.receipts import CORRUPT, parse_receipts, read_receipts
from ledgerscope.streaming.receipts import ingest_receipts


def receipt(i: int) -> dict:
    """An invented receipt: every field of the schema, made-up values."""
    out = {}
    for f in RECEIPT.fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = f"{f.name.lower()}-{i}"
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = i % 2 == 0
        elif isinstance(f.dataType, T.LongType):
            out[f.name] = 1000 + i
        else:
            out[f.name] = 12.5 + i
    out["FirstName"] = None
    out["ExchangeRateMultiplier"] = 1.234567
    return out


def write_files(root: str, start: int, n: int, bad: bool = False) -> None:
    os.makedirs(root, exist_ok=True)
    for i in range(start, start + n):
        with open(os.path.join(root, f"r{i}.json"), "w") as fh:
            json.dump(receipt(i), fh, indent=2)
    if bad:
        with open(os.path.join(root, f"bad{start}.json"), "w") as fh:
            fh.write('{"Reference": "x", "Amount": ')


def test_batch_read_keeps_declared_types(spark):
    root = tempfile.mkdtemp(prefix="receipts-")
    write_files(root, 0, 3, bad=True)
    df = read_receipts(spark, root, multi_line=True)
    assert dict(df.dtypes)["Amount"] == "decimal(20,6)"
    assert dict(df.dtypes)["ExchangeRateMultiplier"] == "decimal(18,6)"
    assert dict(df.dtypes)["FirstName"] == "string"
    good = df.where(F.col(CORRUPT).isNull()).orderBy("NameEnquiryId").collect()
    assert [r.Amount for r in good] == [Decimal("12.50"), Decimal("13.50"), Decimal("14.50")]
    assert good[0].HasBeneficiary is True and good[0].FirstName is None
    # Spark refuses queries that read only the corrupt-record column; read it with another
    bad = df.where(F.col(CORRUPT).isNotNull()).select("Reference", CORRUPT).collect()
    assert len(bad) == 1 and bad[0].Reference is None


def test_parse_json_column(spark):
    df = spark.createDataFrame([(json.dumps(receipt(7)),), ("not json",)], "body string")
    rows = df.select(parse_receipts("body").alias("r")).select("r.Reference", "r.Charges", f"r.{CORRUPT}").collect()
    assert rows[0].Reference == "reference-7" and rows[0].Charges == Decimal("19.50") and rows[0][CORRUPT] is None
    assert rows[1].Reference is None and rows[1][CORRUPT] == "not json"


def test_bad_field_and_wide_decimals_stay_visible(spark):
    df = spark.createDataFrame([('{"Reference": "a", "Amount": "much"}',), ('{"Reference": "b", "Amount": 5000.005}',)], "body string")
    rows = {r.Reference: r for r in df.select(parse_receipts("body").alias("r")).select("r.*").collect()}
    assert rows["a"].Amount is None and "much" in rows["a"][CORRUPT]
    assert rows["b"].Amount == Decimal("5000.005") and rows["b"][CORRUPT] is None


def test_json_lines_are_the_default(spark):
    root = tempfile.mkdtemp(prefix="receipt-lines-")
    with open(os.path.join(root, "a.json"), "w") as fh:
        fh.writelines(json.dumps(receipt(i)) + "\n" for i in range(5))
        fh.write("broken\n")
    df = read_receipts(spark, root).cache()
    assert df.where(F.col(CORRUPT).isNull()).count() == 5
    assert df.where(F.col(CORRUPT) == "broken").count() == 1
    df.unpersist()


def test_stream_ingest_is_incremental(spark):
    base = tempfile.mkdtemp(prefix="receipt-stream-")
    src, out, ckpt = (os.path.join(base, d) for d in ("in", "out", "ckpt"))
    write_files(src, 0, 2)
    ingest_receipts(spark, src, out, ckpt, multi_line=True, max_files=2).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    write_files(src, 2, 3)
    ingest_receipts(spark, src, out, ckpt, multi_line=True, max_files=2).awaitTermination(120)
    landed = spark.read.parquet(out)
    assert landed.count() == 5
    assert landed.select("Reference").distinct().count() == 5
    assert dict(landed.dtypes)["Amount"] == "decimal(20,6)"
