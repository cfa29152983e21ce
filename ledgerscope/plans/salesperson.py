"""Sales-person summary: one row per (sales person, assignee).

The report joins every assignment to its e-mail's transaction totals, to
its sales person's inflow total, to its sales person's assignment counts and
to the balance rows of its (e-mail, holder) -- which were themselves joined
to all assignments first -- and then sums per group.  Its totals therefore
count each assignment ``m`` times, where ``m`` is the number of joined
balance rows (matching assignments x balance rows of the pair, or 1 when
there are none), and the inflow total once per joined row of the group.

This plan reaches the same numbers without materialising those rows:
assignments are first collapsed to distinct (code, assignee, e-mail,
holder) with a count ``_n`` -- the only pass over the assignment table
besides the inflow weights -- balances to one row per pair with their row
count and sums, and the multiplicities are applied as integer weights.
Assignments per pair (``_k``) and per sales person (the business and
customer counts) are window sums over those collapsed rows; a window group
holds at most one row per distinct (code, assignee), however many
assignment rows there are.  Inflow depends only on the code, so it is
joined after the group by.  Revenue uses the tiered rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.money import count_as_int, money_total, revenue_total, weighted
from ledgerscope.operators.stages import (
    ALL,
    BUSINESS,
    CUSTOMER,
    assigned_accounts,
    balance_totals,
    credit_per_holder,
    transactions_breakdown,
)
from ledgerscope.plans.assignment import WindowLike, as_window
from ledgerscope.plans.ordering import order_result
from ledgerscope.schemas import SALES_PERSON_SUMMARY, check_shape
from ledgerscope.sources.tables import Tables

GROUP = ["SalesPersonCode", "AssignedTo"]


def sales_person_rows(
    tables: Tables,
    tx_window: WindowLike,
    credit_window: WindowLike | None = None,
    *,
    revenue_rule: str = "tiered",
) -> DataFrame:
    """The unsorted sales-person summary (see ``sales_person_summary``)."""
    tx_w = as_window(tx_window)
    cr_w = as_window(credit_window) if credit_window is not None else tx_w
    saa = assigned_accounts(tables.sales_assigned_accounts, ALL).select(
        "SalesPersonCode", "AssignedTo", "Email", "AccountHolder"
    )

    keyed = saa.groupBy(*GROUP, "Email", "AccountHolder").agg(F.count(F.lit(1)).alias("_n"))
    keyed = keyed.withColumn("_k", F.sum("_n").over(Window.partitionBy("Email", "AccountHolder")))
    credit = credit_per_holder(
        tables.post_credit_transactions, tables.accounts, tables.customers, tables.businesses, cr_w, tables.credit_months
    )
    # No e-mail filter here: the left join from the assignments drops
    # transactions of unassigned e-mails just the same.
    flows = transactions_breakdown(tables.transactions, tx_w, revenue_rule, emails=None, months=tables.transaction_months)

    rows = (
        keyed.join(balance_totals(tables.daily_balances), ["Email", "AccountHolder"], "left")
        .join(credit, ["Email", "AccountHolder"], "left")
        .join(flows, F.col("Email") == F.col("EmailAddress"), "left")
        .drop("EmailAddress")
    )
    joined_rows = F.when(F.col("_d").isNotNull(), F.col("_k") * F.col("_d")).otherwise(F.lit(1))
    w = F.col("_n") * joined_rows
    holder = F.col("AccountHolder")
    per_group = rows.groupBy(*GROUP).agg(
        F.sum(w).alias("_rows"),
        F.sum(F.when(holder.isNotNull(), w).otherwise(F.lit(0))).alias("_accounts"),
        F.sum(weighted(F.col("totaloutflow"), w)).alias("_outflow"),
        F.sum(weighted(F.col("totalfees"), w)).alias("_fees"),
        F.sum(weighted(F.col("totalrevenue"), w)).alias("_revenue"),
        F.sum(weighted(F.col("_ledger"), F.col("_k") * F.col("_n"))).alias("_ledger"),
        F.sum(weighted(F.col("_available"), F.col("_k") * F.col("_n"))).alias("_available"),
        F.sum(F.col("_amt") * F.col("_n")).alias("_credit"),  # null without any credit
        F.sum(F.when(holder == F.lit(BUSINESS), F.col("_n")).otherwise(F.lit(0))).alias("_business"),
        F.sum(F.when(holder == F.lit(CUSTOMER), F.col("_n")).otherwise(F.lit(0))).alias("_customers"),
    )

    # Per-person inflow and counts over all of the person's assignments (every
    # assignee row shows them in full); a null code never matches, so it gets none.
    person = Window.partitionBy("SalesPersonCode")
    code_known = F.col("SalesPersonCode").isNotNull()
    out = (
        per_group.withColumn("totalinflow", F.when(code_known, F.sum("_credit").over(person)))
        .withColumn("numberofbusiness", F.when(code_known, F.sum("_business").over(person)).otherwise(F.lit(0)))
        .withColumn("numberofcustomers", F.when(code_known, F.sum("_customers").over(person)).otherwise(F.lit(0)))
    )
    return out.select(
        F.col("SalesPersonCode").cast("string").alias("salespersoncode"),
        F.col("AssignedTo").cast("string").alias("assignedto"),
        count_as_int(F.col("_accounts")).alias("totalnumberofaccounts"),
        money_total(F.col("_outflow")).alias("totaloutflow"),
        money_total(F.col("totalinflow") * F.col("_rows")).alias("totalinflow"),
        money_total(F.col("_fees")).alias("totalfees"),
        revenue_total(F.col("_revenue")).alias("totalrevenue"),
        count_as_int(F.coalesce(F.col("numberofbusiness"), F.lit(0))).alias("numberofbusiness"),
        count_as_int(F.coalesce(F.col("numberofcustomers"), F.lit(0))).alias("numberofcustomers"),
        money_total(F.col("_ledger")).alias("totalledgerbalance"),
        money_total(F.col("_available")).alias("totalavailablebalance"),
    )


def sales_person_summary(
    tables: Tables,
    tx_window: WindowLike,
    credit_window: WindowLike | None = None,
    sort_fields: Sequence[str] | None = None,
    sort_dirs: Sequence[str | None] | None = None,
    *,
    revenue_rule: str = "tiered",
) -> DataFrame:
    """Sales-person summary over all assignments.

    Windows as in ``assignment_summary``.  Sorted by the caller's keys; with
    none given the result is left unordered.  Columns: ``SALES_PERSON_SUMMARY``.
    """
    rows = sales_person_rows(tables, tx_window, credit_window, revenue_rule=revenue_rule)
    check_shape(rows.schema, SALES_PERSON_SUMMARY)
    return order_result(rows, sort_fields, sort_dirs)
