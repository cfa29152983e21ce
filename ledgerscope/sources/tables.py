"""The seven source tables as one bundle, and where they come from.

``Tables`` is a plain bundle of DataFrames.  Readers build lazy scans only;
the stages select the columns they use, so Catalyst prunes every scan to
those columns and pushes date and key predicates into Parquet.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.money import exact
from ledgerscope.schemas import MONEY, OPTIONAL_COLUMNS, TABLE_NAMES, TABLE_SCHEMAS


@dataclass(frozen=True)
class Tables:
    """The seven tables, and what a landing may have derived from them.

    ``account_owners`` holds the accounts by owner, in buckets of the owner's
    e-mail (see ``placed_owners``), the ``_months`` tables monthly sums per key
    (see ``sources.rollups``); the reports use them where they are there.
    """

    sales_assigned_accounts: DataFrame
    customers: DataFrame
    businesses: DataFrame
    accounts: DataFrame
    transactions: DataFrame
    post_credit_transactions: DataFrame
    daily_balances: DataFrame
    account_owners: DataFrame | None = None
    transaction_months: DataFrame | None = None
    credit_months: DataFrame | None = None

    def as_dict(self) -> dict[str, DataFrame]:
        """The seven tables by name."""
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def replace(self, **changes: DataFrame | None) -> "Tables":
        """A copy with other tables; what was derived from a replaced one is left out."""
        kept = {d: getattr(self, d) for d, sources in DERIVED.items() if not set(sources) & set(changes)}
        return Tables(**{**self.as_dict(), **kept, **changes})


# What a landing may derive, and from which table.
DERIVED = {
    "account_owners": ("accounts", "customers", "businesses"),
    "transaction_months": ("transactions",),
    "credit_months": ("post_credit_transactions",),
}


# Facts landed by ``write_tables`` carry a month partition column derived from
# their date; it is kept through ``conform`` so window filters can prune
# directories (see ``ledgerscope.operators.stages.in_window``).
PARTITION_COLUMNS: dict[str, tuple[str, str]] = {
    "transactions": ("DateCreated", "created_month"),
    "post_credit_transactions": ("RequestDate", "request_month"),
}


# Landed tables may also carry a bucket of their join key as a partition column
# (facts: after the month); its name says how many buckets there are.
_BUCKET = re.compile(r"key_bucket_of_(\d+)$")


def bucket_column(df: DataFrame) -> str | None:
    """The bucket partition column of a landed table, if it has one."""
    return next((c for c in df.columns if _BUCKET.fullmatch(c)), None)


def bucket_of(key: Column, bucket: str) -> Column:
    """The bucket of a key, as landing wrote it under the column named ``bucket``."""
    return F.pmod(F.xxhash64(key), F.lit(int(_BUCKET.fullmatch(bucket)[1]))).cast("int")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared schema of table ``name`` (cast by name).

    Columns the reports do not use are dropped; a missing optional column
    (``OPTIONAL_COLUMNS``) is added as null and any other missing column
    raises.  Bad money text raises (ANSI rules), and so does money with more
    decimals than the declared type keeps.
    """
    schema = TABLE_SCHEMAS[name]
    have = {c.lower(): c for c in df.columns}
    types = dict(df.dtypes)
    missing = [f.name for f in schema.fields if f.name.lower() not in have and f.name not in OPTIONAL_COLUMNS.get(name, ())]
    if missing:
        raise ValueError(f"table {name} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        if src is None:
            col = F.lit(None).cast(f.dataType)
        elif f.dataType == MONEY:
            col = exact(F.col(f"`{src}`"), types[src], f"{name}.{f.name}")
        else:
            col = F.col(f"`{src}`").cast(f.dataType)
        cols.append(col.alias(f.name))
    part = PARTITION_COLUMNS.get(name)
    if part is not None and part[1].lower() in have:
        cols.append(F.col(have[part[1].lower()]).cast("date").alias(part[1]))
    if name in BUCKETED and (bucket := bucket_column(df)) is not None:
        cols.append(F.col(bucket).cast("int").alias(bucket))
    return df.select(*cols)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet files under ``path``; None where there are none (an empty table landed by partition has no file)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_parquet_tables(
    spark: SparkSession, root: str, names: Mapping[str, str] | None = None
) -> Tables:
    """Read each table from ``root/<name>`` (a Parquet file or directory).

    ``names`` maps our table names to other directory names if they differ.
    Derived tables are read where a landing wrote them; a table that is landed
    by partition may be empty and then has no file.
    """
    names = dict(names or {})
    dfs = {}
    for t in TABLE_NAMES:
        path = os.path.join(root, names.get(t, t))
        found = stored(spark, path)
        if found is None and t not in BUCKETED:
            raise FileNotFoundError(f"no Parquet files under {path}")
        dfs[t] = conform(found, t) if found is not None else spark.createDataFrame([], TABLE_SCHEMAS[t])
    return Tables(**dfs, **{d: stored(spark, os.path.join(root, d)) for d in DERIVED})


def read_catalog_tables(
    spark: SparkSession, names: Mapping[str, str]
) -> Tables:
    """Read the tables from the session catalog, e.g. ``{"transactions": "tx_db.transactions"}``."""
    return Tables(**{t: conform(spark.table(names[t]), t) for t in TABLE_NAMES})


JDBC_PARTITIONING = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    dbtables: Mapping[str, str],
    properties: Mapping[str, str] | None = None,
    partitioning: Mapping[str, Mapping[str, str]] | None = None,
) -> Tables:
    """Read the tables straight from the operational database over JDBC.

    ``dbtables`` maps our names to qualified source names (schema.table).
    ``partitioning`` gives, per table, the JDBC options ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` so that the large
    fact tables are read by many tasks in parallel instead of one.
    Every fact table must have them: without, one task would read it whole.
    Reading is not exercised in the test suite: it needs a live database.
    """
    props = dict(properties or {})
    parts = dict(partitioning or {})
    for t in PARTITION_COLUMNS:
        if lacking := [o for o in JDBC_PARTITIONING if o not in parts.get(t, {})]:
            raise ValueError(f"partitioning of {t} lacks {', '.join(lacking)}")
    dfs = {}
    for t in TABLE_NAMES:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtables[t])
        for k, v in {**props, **parts.get(t, {})}.items():
            reader = reader.option(k, v)
        dfs[t] = conform(reader.load(), t)
    return Tables(**dfs)


# How a landed copy of each table is laid out: facts partitioned by month of
# their date column and clustered by join key inside files, so window
# filters prune directories and key joins read compact row groups.
SORT_KEYS: dict[str, str] = {
    "sales_assigned_accounts": "SalesPersonCode",
    "customers": "UserName",
    "businesses": "Email",
    "accounts": "AccountNumber",
    "transactions": "EmailAddress",
    "post_credit_transactions": "BeneficiaryAccountNumber",
    "daily_balances": "UserName",
    "account_owners": "_owner",
    "transaction_months": "EmailAddress",
    "credit_months": "BeneficiaryAccountNumber",
}


# Tables that ``buckets`` lays out by a hash of their sort key.
BUCKETED = ("customers", "businesses", "transactions", "post_credit_transactions", "daily_balances")


def owners_of(accounts: DataFrame) -> DataFrame:
    """Accounts keyed by owner: (``_kind`` 'C'/'B', ``_owner`` id, ``AccountNumber``).

    An account row yields one key per non-null owner column, so the
    disjunctive "customer id matches OR business id matches" join becomes a
    single equi join on (kind, id).
    """
    owners = F.array(
        F.struct(F.lit("C").alias("_kind"), F.col("CustomerId").alias("_owner")),
        F.struct(F.lit("B").alias("_kind"), F.col("BusinessId").alias("_owner")),
    )
    return (
        accounts.select("AccountNumber", F.inline(owners))
        .where(F.col("_owner").isNotNull())
        .select("_kind", "_owner", "AccountNumber")
    )


def placed_owners(tables: Tables, buckets: int) -> DataFrame:
    """``owners_of`` the accounts with the bucket of the e-mail of the owner's customer or business record.

    A person's report knows its e-mails first, so this placement lets them
    prune the accounts before any record has been read.  An account is there
    once per bucket of its owner's records (one, but for owners with several e-mails); owners
    without a record or e-mail own nothing a report could reach and are left out.
    """
    bucket = f"key_bucket_of_{buckets}"
    parts = [
        df.where(F.col(email).isNotNull()).select(F.lit(kind).alias("_kind"), F.col("Id").alias("_owner"), bucket_of(F.col(email), bucket).alias(bucket))
        for df, email, kind in ((tables.customers, "UserName", "C"), (tables.businesses, "Email", "B"))
    ]
    return owners_of(tables.accounts).join(parts[0].union(parts[1]).distinct(), ["_kind", "_owner"])


def lay_out(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, list[str]]:
    """``df`` with its partition columns, and their names, as ``write_tables`` lands table ``name``."""
    if name == "account_owners":
        return df, [bucket_column(df)]
    old = bucket_column(df)
    landed, by = (df.drop(old) if old else df), []
    if name in PARTITION_COLUMNS:
        date_col, part_col = PARTITION_COLUMNS[name]
        landed = landed.withColumn(part_col, F.trunc(F.col(date_col).cast("date"), "month"))
        by.append(part_col)
    if buckets and name in BUCKETED:
        by.append(f"key_bucket_of_{buckets}")
        landed = landed.withColumn(by[-1], bucket_of(F.col(SORT_KEYS[name]), by[-1]))
    return landed, by


def arranged(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Rows spread over writer tasks by range, and sorted as the files of table ``name`` are.

    The last range key is a deterministic hash of the whole row, so one
    month, and even one hot key inside it, is split between tasks.
    """
    order = [*by, SORT_KEYS[name]]
    if name in PARTITION_COLUMNS:
        order.append(PARTITION_COLUMNS[name][0])
    return df.repartitionByRange(*order, F.xxhash64(*[F.col(c) for c in df.columns])).sortWithinPartitions(*order)


def write_tables(tables: Tables, root: str, mode: str = "errorifexists", buckets: int = 0) -> None:
    """Land the tables as Parquet under ``root`` using ``SORT_KEYS`` and ``PARTITION_COLUMNS``.

    Facts are partitioned by month of their date.  With ``buckets``, facts,
    balances, customers and businesses are also partitioned by a hash bucket
    of their join key, and ``account_owners`` is written too: a date window prunes months, a report of one person prunes
    the buckets of everyone else.  Choose ``buckets`` so that a directory holds at
    least a file's worth of rows.  Files are sorted by the key.
    """
    whole = tables.as_dict()
    if buckets:
        whole["account_owners"] = placed_owners(tables, buckets)
    for name, df in whole.items():
        landed, by = lay_out(df, name, buckets)
        writer = arranged(landed, name, by).write.mode(mode)
        (writer.partitionBy(*by) if by else writer).parquet(os.path.join(root, name))


def stored_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files under ``paths`` (file listing only; contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.agg(F.sum("length")).first()[0] or 0
