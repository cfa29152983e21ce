"""The report stages, each a DataFrame -> DataFrame function.

Row-level stages (``assigned_accounts`` .. ``resolve_accounts``,
``assigned_balances``) return exactly the rows the reports' named steps
produce, fan-out included.  The per-key stages (``inflow``,
``transactions_breakdown``, ``balance_weights``) return one row per key and
are built so that no step ever joins two sides that both repeat a key:

* facts are aggregated to one row per join key *before* they meet a
  dimension (map-side partial aggregation, so a hot key is combined inside
  each task and never travels as raw rows);
* row multiplication that the reports define (one balance row counted once
  per matching assignment, inflow counted once per holder row) is carried as
  integer weights and applied by multiplication, never by emitting pairs.

Decimal sums are exact, so summing per key and then per group gives the
same value as summing the multiplied rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.dates import DateWindow
from ledgerscope.schemas import MONEY
from ledgerscope.sources.rollups import credit_amounts, flow_sums
from ledgerscope.sources.tables import bucket_column, bucket_of, owners_of
from ledgerscope.sources.windows import in_window

CUSTOMER = "Customer"
BUSINESS = "Business"


class _All:
    def __repr__(self) -> str:
        return "<all sales people>"


ALL = _All()


# --------------------------------------------------------------------------
# helpers


def with_keys(rows: DataFrame, key_col: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key_col`` is among the ``Email`` values of ``keys``, as a lazy semi join.

    When the rows carry a landed bucket of that key, the join is on (bucket,
    key): the bucket is a partition column, so dynamic partition pruning skips
    the directories of all other buckets at run time.  Rows grouped by their
    key meet a set that Spark can broadcast before they are grouped (Catalyst
    moves the semi join below the aggregate), a larger one after.
    """
    bucket = bucket_column(rows)
    wanted = keys.select(F.col("Email").alias("_key"), *([bucket_of(F.col("Email"), bucket).alias("_bucket")] if bucket else []))
    on = rows[key_col] == wanted["_key"]
    if bucket:
        on = (rows[bucket] == wanted["_bucket"]) & on
    return rows.join(wanted, on, "left_semi")


def replicate(df: DataFrame, times: str, chunk: int = 4096, copy_col: str | None = None) -> DataFrame:
    """Emit each row ``times`` times (null or < 1 counts as 1); drops ``times``.

    Two nested explodes keep every generated array at most
    ``max(chunk, times / chunk)`` long, so a row repeated millions of times
    never materialises one huge array.  ``copy_col`` keeps the copy's index
    (0-based), e.g. as a final sort key that lets a range partitioner split
    a long run of identical copies between tasks.
    """
    outer = df.selectExpr("*", f"greatest(coalesce(cast(`{times}` AS bigint), 1L), 1L) AS _rep_n").selectExpr(
        "*", f"explode(sequence(0L, (_rep_n - 1) div {chunk})) AS _rep_chunk"
    )
    inner = outer.selectExpr("*", f"explode(sequence(1L, least({chunk}L, _rep_n - _rep_chunk * {chunk}))) AS _rep_i")
    if copy_col is not None:
        inner = inner.selectExpr("*", f"_rep_chunk * {chunk} + _rep_i - 1 AS `{copy_col}`")
    return inner.drop("_rep_n", "_rep_chunk", "_rep_i", times)


# --------------------------------------------------------------------------
# assignments


def assigned_accounts(saa: DataFrame, code: object = ALL) -> DataFrame:
    """Assignment rows of one sales person (``code``), or all of them.

    ``code=None`` compares with null and so selects nothing, as ``= $1``
    does with a null argument.
    """
    if code is ALL:
        return saa
    return saa.where(F.col("SalesPersonCode") == F.lit(code).cast("string"))


def assignment_counts(saa: DataFrame) -> DataFrame:
    """Per sales person: number of business and customer assignments (the base table, all rows).

    The null code forms its own group here, though no ``=`` join can ever
    reach it.
    """
    holder = F.col("AccountHolder")
    return saa.groupBy("SalesPersonCode").agg(
        F.sum(F.when(holder == F.lit(BUSINESS), 1).otherwise(0)).cast("int").alias("numberofbusiness"),
        F.sum(F.when(holder == F.lit(CUSTOMER), 1).otherwise(0)).cast("int").alias("numberofcustomers"),
    )


# --------------------------------------------------------------------------
# holders and accounts (row level)


def holder_records(customers: DataFrame, businesses: DataFrame) -> DataFrame:
    """Customer and business records under one key: (``_kind``, ``_owner``, ``Email``, ``AccountHolder``).

    A landed bucket of the e-mail that both have is kept.
    """
    bucket = bucket_column(customers)
    kept = [bucket] if bucket is not None and bucket == bucket_column(businesses) else []
    cust = customers.selectExpr("'C' AS _kind", "Id AS _owner", "UserName AS Email", f"'{CUSTOMER}' AS AccountHolder", *kept)
    biz = businesses.selectExpr("'B' AS _kind", "Id AS _owner", "Email", f"'{BUSINESS}' AS AccountHolder", *kept)
    return cust.unionByName(biz).where("Email IS NOT NULL")


def account_holders(assigned: DataFrame, customers: DataFrame, businesses: DataFrame) -> DataFrame:
    """Each assignment with the id of its holder: ``CustomerId`` or ``BusinessId``.

    One left join on (e-mail, holder kind): an assignment whose e-mail has no
    record of its kind keeps its row with null ids.  Duplicate user names
    multiply rows, as in the reports.
    """
    a = assigned.select("SalesPersonCode", "Email", "AccountHolder")
    return a.join(holder_records(customers, businesses), ["Email", "AccountHolder"], "left").select(
        "SalesPersonCode",
        "Email",
        "AccountHolder",
        F.when(F.col("_kind") == F.lit("C"), F.col("_owner")).alias("CustomerId"),
        F.when(F.col("_kind") == F.lit("B"), F.col("_owner")).alias("BusinessId"),
    )


account_owners = owners_of


def holder_key(holders: DataFrame) -> DataFrame:
    """Add (``_kind``, ``_owner``) to holder rows; at most one id is ever set."""
    cid, bid = F.col("CustomerId"), F.col("BusinessId")
    return holders.withColumn(
        "_kind", F.when(cid.isNotNull(), F.lit("C")).when(bid.isNotNull(), F.lit("B"))
    ).withColumn("_owner", F.coalesce(cid, bid))


def resolve_accounts(holders: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account numbers of each holder row: (``SalesPersonCode``, ``Email``, ``AccountNumber``).

    Equivalent to joining on ``(CustomerId matches) OR (BusinessId matches)``
    because a holder row carries at most one id; written as one equi join so
    Spark plans a hash or sort-merge join, not a nested loop.
    """
    return (
        holder_key(holders)
        .join(account_owners(accounts), ["_kind", "_owner"], "inner")
        .select("SalesPersonCode", "Email", "AccountNumber")
    )


# --------------------------------------------------------------------------
# inflow (per key)


def credits_per_account(credits: DataFrame, window: DateWindow, months: DataFrame | None = None) -> DataFrame:
    """Credit total per beneficiary account inside ``window``: (``AccountNumber``, ``_amt``).

    ``months``: the landed ``credit_months``, which spares the rows of whole months.
    """
    return credit_amounts(credits, window, months).groupBy("AccountNumber").agg(F.sum("_amt").alias("_amt"))


def owner_inflow(per_account: DataFrame, owners: DataFrame) -> DataFrame:
    """Credit total per owner (``_kind``, ``_owner``); each account row of ``owners`` counts once."""
    return owners.join(per_account, "AccountNumber", "inner").groupBy("_kind", "_owner").agg(F.sum("_amt").alias("_amt"))


def holder_inflow(owner_in: DataFrame, records: DataFrame) -> DataFrame:
    """Credit total per (``Email``, ``AccountHolder``) over every holder record with that e-mail.

    Duplicate customer or business records for one e-mail each count, as the
    row-level joins would count them.
    """
    return records.join(owner_in, ["_kind", "_owner"], "inner").groupBy("Email", "AccountHolder").agg(F.sum("_amt").alias("_amt"))


def credit_per_holder(
    credits: DataFrame, accounts: DataFrame, customers: DataFrame, businesses: DataFrame, window: DateWindow, months: DataFrame | None = None
) -> DataFrame:
    """Credit total per (``Email``, ``AccountHolder``): per account, then per owner, then per holder record."""
    records, owners = holder_records(customers, businesses), account_owners(accounts)
    return holder_inflow(owner_inflow(credits_per_account(credits, window, months), owners), records)


def pair_counts(assigned: DataFrame) -> DataFrame:
    """Assignment rows per (``Email``, ``AccountHolder``) with an e-mail, as ``_k``.

    The filter on the count drops nothing.  It keeps the count in every use of
    the relation, however few columns that use reads, so that Spark sees one and the same
    exchange in all of them and runs it once.
    """
    return assigned.where("Email IS NOT NULL").groupBy("Email", "AccountHolder").agg(F.expr("count(1) AS _k")).where("_k > 0")


def holder_accounts(
    pairs: DataFrame, accounts: DataFrame, customers: DataFrame, businesses: DataFrame, placed: DataFrame | None = None
) -> DataFrame:
    """Accounts of the pairs' holder records: (``Email``, ``AccountHolder``, ``_k``, ``AccountNumber``).

    The one derivation of e-mail, record, owner and account for a person's
    report.  Where customers and businesses have landed buckets of their
    e-mail, and with ``placed`` (the landed ``account_owners``) for the
    accounts, dynamic pruning by the pairs opens only these directories.
    """
    records, owners = holder_records(customers, businesses), owners_of(accounts) if placed is None else placed
    by, to = ["Email", "AccountHolder"], ["_kind", "_owner"]
    if (bucket := bucket_column(records)) is not None:
        pairs, by = pairs.withColumn(bucket, bucket_of(F.col("Email"), bucket)), [bucket, *by]
        if bucket_column(owners) == bucket:
            owners, to = owners.join(pairs.select(bucket, "_k"), bucket, "left_semi"), [bucket, *to]
    mine = records.join(pairs, by, "inner").select("Email", "AccountHolder", "_k", *to)
    return owners.join(mine, to, "inner").select("Email", "AccountHolder", "_k", "AccountNumber")


def pair_inflow(held: DataFrame, credits: DataFrame, window: DateWindow, months: DataFrame | None = None) -> DataFrame:
    """Inflow per e-mail of ``held`` (see ``holder_accounts``): (``Email``, ``totalinflow``).

    A credit counts once per holder record and account row that it reaches
    and once per assignment of that (e-mail, holder).  Credits meet the
    accounts directly: where Spark can broadcast these, other people's credits
    are dropped in the scan's own stage and the rest is summed there.
    """
    amounts, by = credit_amounts(credits, window, months), ["AccountNumber"]
    if (bucket := bucket_column(amounts)) is not None:
        held, by = held.withColumn(bucket, bucket_of(F.col("AccountNumber"), bucket)), [bucket, *by]
    sums = []
    for name, kind in (("_c", CUSTOMER), ("_b", BUSINESS)):
        own = f"FILTER (WHERE AccountHolder = '{kind}')"
        sums += [F.expr(f"sum(_amt) {own} AS {name}"), F.expr(f"max(_k) {own} AS {name}k")]
    total = "coalesce(_c * _ck + _b * _bk, _c * _ck, _b * _bk) AS totalinflow"
    return amounts.join(held, by, "inner").groupBy("Email").agg(*sums).selectExpr("Email", total)


def inflow(
    assigned: DataFrame,
    credits: DataFrame,
    accounts: DataFrame,
    customers: DataFrame,
    businesses: DataFrame,
    window: DateWindow,
    key: str = "Email",
    months: DataFrame | None = None,
) -> DataFrame:
    """Inflow per ``key`` ("Email" or "SalesPersonCode") over the assignments' accounts.

    Same value as joining every credit to every (assignment, holder record,
    account) row and summing per key, computed without those rows: credits
    per (e-mail, holder), weighted by how many assignment rows share the
    (key, e-mail, holder).  A key appears only when at least one credit
    reaches it.  Result: (``key``, ``totalinflow``).
    """
    per_email = credit_per_holder(credits, accounts, customers, businesses, window, months)
    group = [key] if key == "Email" else [key, "Email"]
    weights = assigned.groupBy(*group, "AccountHolder").agg(F.count(F.lit(1)).alias("_n"))
    return (
        weights.join(per_email, ["Email", "AccountHolder"], "inner")
        .groupBy(key)
        .agg(F.sum(F.col("_amt") * F.col("_n")).alias("totalinflow"))
    )


# --------------------------------------------------------------------------
# transactions (per e-mail)


def transactions_breakdown(
    tx: DataFrame,
    window: DateWindow,
    rule: str = "flat",
    emails: DataFrame | None = None,
    deposit: bool = False,
    months: DataFrame | None = None,
) -> DataFrame:
    """Outflow, fees and revenue per e-mail inside ``window``.

    ``emails`` (a frame with an ``Email`` column) keeps only e-mails in it.
    The transactions are aggregated first (partial aggregation shrinks them
    to one row per e-mail per task before the shuffle) and only the aggregate
    meets the e-mail set, which suits a set of most e-mails; ``person_flows``
    suits one person's.  Both give the same rows, because the filter is on the
    grouping key.  ``emails=None`` skips the filter for callers that join the
    result to assignments anyway.  ``months``: the landed
    ``transaction_months``, which spares the rows of whole months.

    Result: ``EmailAddress``, ``totaloutflow``, ``totalfees``,
    ``totalrevenue`` (and ``totaldeposit`` when ``deposit``).
    """
    summed = flow_sums(tx, window, rule, deposit, months)
    if (bucket := bucket_column(summed)) is not None:
        summed = summed.drop(bucket)
    if emails is None:
        return summed
    keys = emails.select(F.col("Email").alias("EmailAddress")).where(F.col("EmailAddress").isNotNull())
    return summed.join(keys.distinct(), "EmailAddress", "inner")


def person_flows(tx: DataFrame, window: DateWindow, rule: str, keys: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """``transactions_breakdown`` of the e-mails of ``keys`` (see ``with_keys``), with ``Email`` as the key's name."""
    mine = with_keys(flow_sums(tx, window, rule, False, months), "EmailAddress", keys)
    return mine.selectExpr("EmailAddress AS Email", "totaloutflow", "totalfees", "totalrevenue")


# --------------------------------------------------------------------------
# balances


def balance_totals(balances: DataFrame) -> DataFrame:
    """Per (``Email``, ``AccountHolder``): balance row count ``_d`` and sums ``_ledger``, ``_available``."""
    return (
        balances.where(F.col("UserName").isNotNull() & F.col("AccountHolder").isNotNull())
        .groupBy(F.col("UserName").alias("Email"), "AccountHolder")
        .agg(
            F.count(F.lit(1)).alias("_d"),
            F.sum(F.col("TotalLedgerBalance").cast(MONEY)).alias("_ledger"),
            F.sum(F.col("TotalAvailableBalance").cast(MONEY)).alias("_available"),
        )
    )


def balance_weights(balances: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per assigned (``Email``, ``AccountHolder``): balance rows and how often each repeats.

    The reports join balances to assignments and then join that result to
    the assignments again, so every balance row of an (e-mail, holder)
    shows up once per assignment sharing that pair.  Here: ``_k`` =
    assignments with the pair, ``_d`` = balance rows, ``_ledger`` /
    ``_available`` = their sums.  One row per pair, no pairs emitted.
    """
    k = (
        assigned.where(F.col("Email").isNotNull() & F.col("AccountHolder").isNotNull())
        .groupBy("Email", "AccountHolder")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    return balance_totals(balances).join(k, ["Email", "AccountHolder"], "inner")


def weighted_balance_rows(balances: DataFrame, assigned: DataFrame) -> DataFrame:
    """Balance rows of assigned (e-mail, holder) pairs, each with its repeat count ``_k``."""
    k = (
        assigned.where(F.col("Email").isNotNull() & F.col("AccountHolder").isNotNull())
        .groupBy("Email", "AccountHolder")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    b = balances.select(
        F.col("UserName").alias("Email"),
        "AccountHolder",
        F.col("TotalLedgerBalance").cast(MONEY).alias("TotalLedgerBalance"),
        F.col("TotalAvailableBalance").cast(MONEY).alias("TotalAvailableBalance"),
    )
    return b.join(k, ["Email", "AccountHolder"], "inner")


def assigned_balances(balances: DataFrame, assigned: DataFrame) -> DataFrame:
    """Balance rows joined to the assignments on (e-mail, holder), as rows.

    No date is read and no latest row is picked: every balance row is kept,
    once per matching assignment.  Result: ``UserName``, ``AccountHolder``,
    ``TotalLedgerBalance``, ``TotalAvailableBalance``.
    """
    rows = weighted_balance_rows(balances, assigned)
    return replicate(rows, "_k").select(
        F.col("Email").alias("UserName"), "AccountHolder", "TotalLedgerBalance", "TotalAvailableBalance"
    )


def balances_by_email(balances: DataFrame, assigned: DataFrame, keep_holder: bool = False) -> DataFrame:
    """Historic form: balance rows whose user name is any assigned e-mail (holder ignored).

    A semi join, so rows are never repeated.  Result: ``UserName``,
    ``TotalLedgerBalance``, ``TotalAvailableBalance`` (and ``AccountHolder``
    after the user name when ``keep_holder``).
    """
    return with_keys(balances, "UserName", assigned).select(
        "UserName",
        *(["AccountHolder"] if keep_holder else []),
        F.col("TotalLedgerBalance").cast(MONEY).alias("TotalLedgerBalance"),
        F.col("TotalAvailableBalance").cast(MONEY).alias("TotalAvailableBalance"),
    )


__all__ = [
    "ALL",
    "account_holders",
    "account_owners",
    "assigned_accounts",
    "assigned_balances",
    "assignment_counts",
    "balance_totals",
    "balance_weights",
    "balances_by_email",
    "credit_per_holder",
    "credits_per_account",
    "holder_accounts",
    "holder_inflow",
    "holder_records",
    "in_window",
    "inflow",
    "owner_inflow",
    "pair_counts",
    "pair_inflow",
    "person_flows",
    "replicate",
    "resolve_accounts",
    "transactions_breakdown",
    "weighted_balance_rows",
    "with_keys",
]
