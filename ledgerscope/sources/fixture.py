"""The seven report tables derived from the supplied TPC-H-style test data.

The mapping (FIXTURES.md §2) is written here with the DataFrame API; the
DuckDB oracle writes the same mapping in SQL, so a mistake on either side
shows up as a mismatch.  Every derivation is a narrow projection/filter of
one supplied table, unioned: no joins, no shuffles.
"""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.schemas import MONEY
from ledgerscope.sources.tables import Tables, conform


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def pad(c: str, width: int) -> Column:
    return F.lpad(_s(c), width, "0")


def customer_email(key: str = "c_custkey") -> Column:
    return F.concat(F.lit("c"), _s(key), F.lit("@example.com"))


def business_email(key: str = "s_suppkey") -> Column:
    prefix = F.when(F.col(key) % 7 == 0, F.lit("c")).otherwise(F.lit("b"))
    return F.concat(prefix, _s(key), F.lit("@example.com"))


def plus_hours(ts: str, hours: Column) -> Column:
    return F.col(ts) + F.make_dt_interval(F.lit(0), hours.cast("int"))


def money(c: Column | str) -> Column:
    """Supplied (floating-point) money to whole cents, as ``MONEY``."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)").cast(MONEY)


def mills(c: Column) -> Column:
    """An integer number of thousandths, as ``MONEY``."""
    return (c.cast("decimal(10,0)") * F.lit(Decimal("0.001"))).cast(MONEY)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _code(nation: Column) -> Column:
    return F.concat(F.lit("SAL-"), F.lpad(nation.cast("string"), 4, "0"))


def _agent(nation: Column) -> Column:
    return F.concat(F.lit("Agent "), nation.cast("string"))


def sales_assigned_accounts(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    nation = F.col("c_nationkey")
    cover = F.when(F.col("c_custkey") % 40 == 2, F.lit(" (cover)")).otherwise(F.lit(""))
    primary = customer.where(F.col("c_custkey") % 3 != 0).select(
        _code(nation).alias("SalesPersonCode"),
        F.concat(_agent(nation), cover).alias("AssignedTo"),
        customer_email().alias("Email"),
        F.col("c_name").alias("AccountName"),
        F.concat(F.lit("080"), pad("c_custkey", 8)).alias("PhoneNumber"),
        F.lit("Customer").alias("AccountHolder"),
    )
    snation = F.col("s_nationkey")
    business = supplier.where(F.col("s_suppkey") % 4 != 3).select(
        _code(snation).alias("SalesPersonCode"),
        _agent(snation).alias("AssignedTo"),
        business_email().alias("Email"),
        F.col("s_name").alias("AccountName"),
        F.concat(F.lit("090"), pad("s_suppkey", 8)).alias("PhoneNumber"),
        F.lit("Business").alias("AccountHolder"),
    )
    next_nation = (F.col("c_nationkey") + 1) % 25
    second = customer.where(F.col("c_custkey") % 50 == 1).select(
        _code(next_nation).alias("SalesPersonCode"),
        _agent(next_nation).alias("AssignedTo"),
        customer_email().alias("Email"),
        F.col("c_name").alias("AccountName"),
        F.concat(F.lit("080"), pad("c_custkey", 8)).alias("PhoneNumber"),
        F.lit("Customer").alias("AccountHolder"),
    )
    unassigned = customer.where(F.col("c_custkey") % 30 == 0).select(
        F.lit(None).cast("string").alias("SalesPersonCode"),
        F.lit(None).cast("string").alias("AssignedTo"),
        customer_email().alias("Email"),
        F.col("c_name").alias("AccountName"),
        F.lit(None).cast("string").alias("PhoneNumber"),
        F.lit("Customer").alias("AccountHolder"),
    )
    # The same assignment twice; an assignment without an e-mail; other holder kinds.
    repeated = primary.where(F.pmod(F.substring("PhoneNumber", 4, 8).cast("int"), F.lit(12)) == 7)
    no_email = customer.where(F.col("c_custkey") % 20 == 1).select(
        _code(nation).alias("SalesPersonCode"),
        _agent(nation).alias("AssignedTo"),
        F.lit(None).cast("string").alias("Email"),
        F.col("c_name").alias("AccountName"),
        F.concat(F.lit("080"), pad("c_custkey", 8)).alias("PhoneNumber"),
        F.lit("Customer").alias("AccountHolder"),
    )
    other = supplier.where(F.col("s_suppkey") % 3 == 1).select(
        _code(snation).alias("SalesPersonCode"),
        _agent(snation).alias("AssignedTo"),
        business_email().alias("Email"),
        F.col("s_name").alias("AccountName"),
        F.concat(F.lit("090"), pad("s_suppkey", 8)).alias("PhoneNumber"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("Partner")).alias("AccountHolder"),
    )
    out = primary
    for part in (business, second, unassigned, repeated, no_email, other):
        out = out.unionByName(part)
    return out


def customers(customer: DataFrame) -> DataFrame:
    once = customer.select(
        F.concat(F.lit("CU"), pad("c_custkey", 8)).alias("Id"), customer_email().alias("UserName")
    )
    return once.unionByName(once.where(F.pmod(F.substring("Id", 3, 8).cast("int"), F.lit(18)) == 1))  # duplicate records


def businesses(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.concat(F.lit("BU"), pad("s_suppkey", 8)).alias("Id"), business_email().alias("Email")
    )


def accounts(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    first = customer.select(
        F.concat(F.lit("A1"), pad("c_custkey", 8)).alias("AccountNumber"),
        F.concat(F.lit("CU"), pad("c_custkey", 8)).alias("CustomerId"),
        none.alias("BusinessId"),
    )
    second = customer.where(F.col("c_custkey") % 5 == 0).select(
        F.concat(F.lit("A2"), pad("c_custkey", 8)).alias("AccountNumber"),
        F.concat(F.lit("CU"), pad("c_custkey", 8)).alias("CustomerId"),
        none.alias("BusinessId"),
    )
    biz = supplier.select(
        F.concat(F.lit("AB"), pad("s_suppkey", 8)).alias("AccountNumber"),
        none.alias("CustomerId"),
        F.concat(F.lit("BU"), pad("s_suppkey", 8)).alias("BusinessId"),
    )
    return first.unionByName(second).unionByName(biz)


def transactions(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    email = (
        F.when(key % 10 == 0, F.concat(F.lit("b"), _s(key % 100), F.lit("@example.com")))
        .otherwise(F.concat(F.lit("c"), _s("o_custkey"), F.lit("@example.com")))
    )
    status = F.col("o_orderstatus")
    ttype = (
        F.when(key % 17 == 0, F.lit(None).cast("string"))
        .when(status == "F", F.lit("Outflow")).when(status == "O", F.lit("Inflow")).otherwise(F.lit("Reversal"))
    )
    slot = key % 5
    fee = (
        F.when(key % 15 == 0, F.lit(Decimal("10.754")).cast(MONEY))  # near a tier, but not on it
        .when(slot == 0, money(F.lit("10.75")))
        .when(slot == 1, money(F.lit("26.88")))
        .when(slot == 2, money(F.lit("53.75")))
        .when(slot == 3, F.lit(None).cast(MONEY))
        .otherwise(money(F.col("o_custkey") % 100 + F.lit(0.25).cast("decimal(3,2)")))
    )
    return orders.select(
        email.alias("EmailAddress"),
        ttype.alias("TransactionType"),
        (money("o_totalprice") + mills(key % 4)).cast(MONEY).alias("Amount"),
        fee.alias("TransactionFee"),
        plus_hours("o_orderdate", key % 24).alias("DateCreated"),
    )


def post_credit_transactions(lineitem: DataFrame) -> DataFrame:
    slot = F.col("l_linenumber") % 3
    beneficiary = (
        F.when(slot == 0, F.concat(F.lit("AB"), pad("l_suppkey", 8)))
        .when(slot == 1, F.concat(F.lit("A1"), pad("l_partkey", 8)))
        .otherwise(F.concat(F.lit("A2"), pad("l_partkey", 8)))
    )
    return lineitem.select(
        beneficiary.alias("BeneficiaryAccountNumber"),
        money("l_extendedprice").alias("Amount"),
        plus_hours("l_shipdate", F.col("l_orderkey") % 24).alias("RequestDate"),
    )


def daily_balances(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    bal = money("c_acctbal")
    latest = customer.where(F.col("c_custkey") % 11 != 10).select(
        customer_email().alias("UserName"),
        F.lit("Customer").alias("AccountHolder"),
        bal.alias("TotalLedgerBalance"),
        money(bal - 100).alias("TotalAvailableBalance"),
        F.lit(dt.date(2024, 12, 31)).alias("BalanceDate"),
    )
    older = customer.where(F.col("c_custkey") % 10 == 1).select(
        customer_email().alias("UserName"),
        F.lit("Customer").alias("AccountHolder"),
        money(bal + 50).alias("TotalLedgerBalance"),
        money(bal - 50).alias("TotalAvailableBalance"),
        F.lit(dt.date(2024, 12, 30)).alias("BalanceDate"),
    )
    sbal = money("s_acctbal")
    biz = supplier.where(F.col("s_suppkey") % 6 != 5).select(
        business_email().alias("UserName"),
        F.lit("Business").alias("AccountHolder"),
        sbal.alias("TotalLedgerBalance"),
        sbal.alias("TotalAvailableBalance"),
        F.lit(dt.date(2024, 12, 31)).alias("BalanceDate"),
    )
    return latest.unionByName(older).unionByName(biz)


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Derive all seven tables lazily from ``sf_dir``'s supplied Parquet files."""
    customer = _read(spark, sf_dir, "customer")
    supplier = _read(spark, sf_dir, "supplier")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    raw = {
        "sales_assigned_accounts": sales_assigned_accounts(customer, supplier),
        "customers": customers(customer),
        "businesses": businesses(supplier),
        "accounts": accounts(customer, supplier),
        "transactions": transactions(orders),
        "post_credit_transactions": post_credit_transactions(lineitem),
        "daily_balances": daily_balances(customer, supplier),
    }
    return Tables(**{name: conform(df, name) for name, df in raw.items()})
