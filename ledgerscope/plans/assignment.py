"""Assignment summary: one sales person's assigned accounts with flows and balances.

One output row per assignment row and per balance row of its (e-mail,
holder), each balance row repeated once per assignment of that person
sharing the pair, as the report defines it.  Accounts without activity are
kept with zeros.  Revenue uses the flat rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.dates import OMITTED, DateLike, DateWindow, default_window
from ledgerscope.operators.stages import (
    assigned_accounts,
    balances_by_email,
    holder_accounts,
    pair_counts,
    pair_inflow,
    person_flows,
    replicate,
)
from ledgerscope.plans.ordering import ascending, sort_columns
from ledgerscope.schemas import ASSIGNMENT_SUMMARY, check_shape
from ledgerscope.sources.tables import Tables

WindowLike = DateWindow | tuple[DateLike, DateLike]


def as_window(w: WindowLike) -> DateWindow:
    return w if isinstance(w, DateWindow) else DateWindow.of(*w)


# Assignment rows of one (e-mail, holder) that meet one copy of its measures.
ROWS_PER_COPY = 500


def rows_with_measures(assigned: DataFrame, measures: DataFrame, rows_per_copy: int = ROWS_PER_COPY) -> DataFrame:
    """Assignment rows left-joined to ``measures``, which has rows per (``Email``, ``AccountHolder``) and their count ``_k``.

    The measures of a pair are copied once per ``rows_per_copy`` of its
    assignments, and its assignments are dealt to these copies, so a hot pair
    is split by its size while any other is copied once.  Only pairs of more than one copy
    are looked up for that, at most a ``rows_per_copy``-th of the assignments.
    Rows without an e-mail match nothing; their row number spreads them.
    """
    copies = f"cast(ceil(_k / {rows_per_copy}) AS bigint)"
    hot = pair_counts(assigned).where(f"_k > {rows_per_copy}").selectExpr("Email AS _hot_email", "AccountHolder AS _hot_holder", f"{copies} AS _copies_of")
    numbered = assigned.select("*", F.monotonically_increasing_id().alias("_row"))
    dealt = numbered.join(hot, F.expr("coalesce(Email, concat('\\0', _row)) = _hot_email AND AccountHolder <=> _hot_holder"), "left")
    left = dealt.selectExpr(*assigned.columns, "CASE WHEN Email IS NULL THEN _row ELSE pmod(_row, coalesce(_copies_of, 1L)) END AS _salt").alias("l")
    right = measures.selectExpr("*", f"explode(sequence(0L, {copies} - 1)) AS _salt").alias("r")
    on = F.expr("l.Email = r.Email AND l._salt = r._salt AND l.AccountHolder <=> r.AccountHolder")
    kept = [f"r.{c}" for c in measures.columns if c not in ("Email", "AccountHolder", "_k")]
    return left.join(right, on, "left").select(*(f"l.{c}" for c in assigned.columns), *kept)


def assignment_rows(
    tables: Tables,
    code: object,
    tx_window: WindowLike,
    credit_window: WindowLike | None = None,
    *,
    balance_match: str = "holder",
    revenue_rule: str = "flat",
    copy_col: str | None = None,
) -> DataFrame:
    """The unsorted assignment summary (see ``assignment_summary``).

    One lazy plan at every size.  The person's (e-mail, holder) pairs are one
    relation that restricts transactions, balances, customers and businesses,
    and through these the accounts and credits; every table is scanned once,
    besides the assignments, which come back at the end with all their columns
    (``rows_with_measures``).

    ``copy_col`` adds the index of each repeated balance row (0 otherwise),
    for use as a last sort key.
    """
    if balance_match not in ("holder", "email"):
        raise ValueError("balance_match must be 'holder' or 'email'")
    tx_w = as_window(tx_window)
    cr_w = as_window(credit_window) if credit_window is not None else tx_w
    assigned = assigned_accounts(tables.sales_assigned_accounts, code).select(
        "Email", "AccountName", "PhoneNumber", "AccountHolder"
    )
    pairs = pair_counts(assigned)

    held = holder_accounts(pairs, tables.accounts, tables.customers, tables.businesses, tables.account_owners)
    inflow = pair_inflow(held, tables.post_credit_transactions, cr_w, tables.credit_months)
    flows = person_flows(tables.transactions, tx_w, revenue_rule, pairs, tables.transaction_months)
    balances = balances_by_email(tables.daily_balances, pairs, keep_holder=balance_match == "holder").withColumnRenamed("UserName", "Email")

    by_pair = pairs.join(flows, "Email", "left").join(inflow, "Email", "left")
    if balance_match == "holder":
        by_pair = by_pair.join(balances.selectExpr("*", "true AS _found"), ["Email", "AccountHolder"], "left")
        copies = "CASE WHEN _found THEN _k ELSE 1L END AS _copies"
    else:
        by_pair = by_pair.join(balances, "Email", "left")
        copies = "1L AS _copies"
    measures = ["totaloutflow", "totalinflow", "totalfees", "totalrevenue", "TotalLedgerBalance", "TotalAvailableBalance"]
    by_pair = by_pair.selectExpr("Email", "AccountHolder", "_k", *measures, copies)
    rows = replicate(rows_with_measures(assigned, by_pair), "_copies", copy_col=copy_col)

    # One expression per result column: building a plan is most of a small report's time.
    total = "coalesce(cast({0} AS {1}), cast(0 AS {1})) AS {2}"
    columns = []
    for f, source in zip(ASSIGNMENT_SUMMARY.fields, ["Email", "AccountName", "PhoneNumber", "AccountHolder", *measures], strict=True):
        kind = f.dataType.simpleString()
        columns.append(f"cast({source} AS string) AS {f.name}" if kind == "string" else total.format(source, kind, f.name))
    return rows.selectExpr(*columns, *([copy_col] if copy_col is not None else []))


def assignment_summary(
    tables: Tables,
    code: object,
    tx_window: WindowLike,
    credit_window: WindowLike | None = None,
    sort_fields: Sequence[str] | None = None,
    sort_dirs: Sequence[str | None] | None = None,
    *,
    balance_match: str = "holder",
    revenue_rule: str = "flat",
) -> DataFrame:
    """Assignment summary for sales person ``code``.

    ``tx_window`` bounds transactions, ``credit_window`` (default: the same)
    bounds inward credits; either is a ``DateWindow`` or a ``(start, end)``
    pair, and a None bound empties that side.  Sorted by the caller's keys,
    else by e-mail.  ``balance_match="email"`` gives the historic variant
    that matches balances by e-mail only.

    Columns: ``ASSIGNMENT_SUMMARY``.
    """
    rows = assignment_rows(
        tables,
        code,
        tx_window,
        credit_window,
        balance_match=balance_match,
        revenue_rule=revenue_rule,
        copy_col="_copy",
    )
    check_shape(rows.drop("_copy").schema, ASSIGNMENT_SUMMARY)
    # The copy index is the last sort key, so a long run of identical repeated
    # rows is still split between range partitions; it is dropped after the sort.
    visible = [c for c in rows.columns if c != "_copy"]
    keys = sort_columns(visible, sort_fields, sort_dirs) or [ascending("email")]
    return rows.orderBy(*keys, F.col("_copy").asc()).drop("_copy")


def assignment_summary_with_defaults(
    tables: Tables,
    code: object,
    start: DateLike = None,
    end: DateLike | object = OMITTED,
    sort_fields: Sequence[str] | None = None,
    sort_dirs: Sequence[str | None] | None = None,
    *,
    as_of: DateLike = None,
) -> DataFrame:
    """Development form: ``start`` defaults to the first transaction day, ``end`` to ``as_of``.

    One window bounds both transactions and credits, so credits older than
    the first transaction are left out when ``start`` is defaulted.
    """
    window = default_window(tables.transactions, start, end, as_of)
    return assignment_summary(tables, code, window, None, sort_fields, sort_dirs)
