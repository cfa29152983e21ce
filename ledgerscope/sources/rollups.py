"""Monthly sums of the facts per key, and facts read through them.

A window of years needs raw rows only at its two ends: every whole month in
between is one row per key in a roll-up, landed beside the facts with the same
month and key-bucket directories.  All measures are sums, and decimal sums are
exact, so a window read through roll-ups gives the same values as one read from rows.

Roll-ups hold the columns of one fact per (month, key):

* ``transaction_months``: ``EmailAddress``, outflow, fees, deposit, and
  revenue under either rule;
* ``credit_months``: ``BeneficiaryAccountNumber``, amount.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.dates import DateWindow
from ledgerscope.functions.revenue import INFLOW, OUTFLOW, revenue, when_type
from ledgerscope.schemas import MONEY, MONEY_TOTAL, REVENUE_TOTAL
from ledgerscope.sources.tables import PARTITION_COLUMNS, Tables, arranged, bucket_column
from ledgerscope.sources.windows import edge_rows, in_window, whole_months

RULES = ("flat", "tiered")


def _flows(rule: str, deposit: bool) -> dict[str, Column]:
    ttype, fee, amount = F.col("TransactionType"), F.col("TransactionFee").cast(MONEY), F.col("Amount").cast(MONEY)
    flows = {
        "totaloutflow": when_type(ttype, OUTFLOW, amount),
        "totalfees": when_type(ttype, OUTFLOW, fee),
        "totalrevenue": revenue(ttype, fee, rule),
    }
    return flows | ({"totaldeposit": when_type(ttype, INFLOW, amount)} if deposit else {})


def flow_sums(tx: DataFrame, window: DateWindow, rule: str, deposit: bool, months: DataFrame | None) -> DataFrame:
    """Flow sums per e-mail (and landed bucket) inside ``window``: from rows, or with ``months`` from rows of its edges only."""
    flows = _flows(rule, deposit)
    inner = whole_months(window) if months is not None else None
    bucket = bucket_column(tx)
    keys = ["EmailAddress", *([bucket] if bucket else [])]
    if inner is None:
        return in_window(tx, "DateCreated", window).groupBy(*keys).agg(*(F.sum(c).alias(m) for m, c in flows.items()))
    wide = {m: REVENUE_TOTAL if m == "totalrevenue" else MONEY_TOTAL for m in flows}
    raw = edge_rows(tx, "DateCreated", "created_month", window).select(*keys, *(c.cast(wide[m]).alias(m) for m, c in flows.items()))
    whole = months.where(F.col("created_month").between(*inner)).select(
        *keys, *(F.col(f"{rule}revenue" if m == "totalrevenue" else m).cast(wide[m]).alias(m) for m in flows)
    )
    return raw.unionByName(whole).groupBy(*keys).agg(*(F.sum(m).alias(m) for m in flows))


def credit_amounts(credits: DataFrame, window: DateWindow, months: DataFrame | None) -> DataFrame:
    """(``AccountNumber``, ``_amt``, landed bucket) inside ``window``: credit rows, or with ``months`` those of its edges and monthly sums."""
    inner = whole_months(window) if months is not None else None
    bucket = bucket_column(credits)
    known = F.col("BeneficiaryAccountNumber").isNotNull()

    def shaped(rows: DataFrame, amount: Column) -> DataFrame:
        return rows.where(known).select(F.col("BeneficiaryAccountNumber").alias("AccountNumber"), amount.alias("_amt"), *([bucket] if bucket else []))

    if inner is None:
        return shaped(in_window(credits, "RequestDate", window), F.col("Amount").cast(MONEY))
    raw = shaped(edge_rows(credits, "RequestDate", "request_month", window), F.col("Amount").cast(MONEY_TOTAL))
    return raw.unionByName(shaped(months.where(F.col("request_month").between(*inner)), F.col("_amt").cast(MONEY_TOTAL)))


def monthly(fact: DataFrame, name: str) -> DataFrame:
    """The roll-up ``name`` of landed rows of its fact (which carry a month)."""
    bucket = bucket_column(fact)
    extra = [bucket] if bucket else []
    if name == "transaction_months":
        sums = {m: c for m, c in _flows("flat", True).items() if m != "totalrevenue"} | {f"{r}revenue": _flows(r, False)["totalrevenue"] for r in RULES}
        return fact.groupBy("created_month", *extra, "EmailAddress").agg(*(F.sum(c).alias(m) for m, c in sums.items()))
    return fact.groupBy("request_month", *extra, "BeneficiaryAccountNumber").agg(F.sum(F.col("Amount").cast(MONEY)).alias("_amt"))


ROLLUPS = {"transaction_months": "transactions", "credit_months": "post_credit_transactions"}


def roll_up(landed: Tables, name: str) -> tuple[DataFrame, list[str]]:
    """Roll-up ``name`` of landed tables, arranged for writing, and its partition columns."""
    fact = ROLLUPS[name]
    df = getattr(landed, fact)
    part = PARTITION_COLUMNS[fact][1]
    if part not in df.columns:
        raise ValueError(f"{fact} was not landed by month")
    bucket = bucket_column(df)
    by = [part, *([bucket] if bucket else [])]
    return arranged(monthly(df, name), name, by), by


def write_rollups(landed: Tables, root: str, mode: str = "errorifexists") -> None:
    """Land both roll-ups of tables landed by ``write_tables`` beside them (an empty fact has none)."""
    for name, fact in ROLLUPS.items():
        if getattr(landed, fact).isEmpty():
            continue
        df, by = roll_up(landed, name)
        df.write.mode(mode).partitionBy(*by).parquet(os.path.join(root, name))
