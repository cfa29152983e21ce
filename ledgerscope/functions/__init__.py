"""Column-level building blocks: money casts, revenue rules, date windows."""

from ledgerscope.functions.dates import OMITTED, DateWindow, default_window, parse_date
from ledgerscope.functions.money import as_money, count_as_int, money_total, revenue_total, zero_if_null
from ledgerscope.functions.revenue import (
    FEE_TIERS,
    FLAT_REVENUE_RATE,
    INFLOW,
    OUTFLOW,
    flat_revenue,
    revenue,
    tiered_revenue,
    when_type,
)

__all__ = [
    "OMITTED",
    "DateWindow",
    "default_window",
    "parse_date",
    "as_money",
    "count_as_int",
    "money_total",
    "revenue_total",
    "zero_if_null",
    "FEE_TIERS",
    "FLAT_REVENUE_RATE",
    "INFLOW",
    "OUTFLOW",
    "flat_revenue",
    "revenue",
    "tiered_revenue",
    "when_type",
]
