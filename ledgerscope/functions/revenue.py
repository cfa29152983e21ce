"""Revenue rules applied to one transaction row.

Both rules give revenue only for outflows; any other (or null) type gives 0.
A null fee on an outflow yields null, which ``SUM`` then skips.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reports' own rules.
OUTFLOW = "Outflow"
INFLOW = "Inflow"
FLAT_REVENUE_RATE = Decimal("0.93")
# (fee charged, revenue booked) for the tiered rule; other fees fall back to the flat rate.
FEE_TIERS: tuple[tuple[Decimal, Decimal], ...] = (
    (Decimal("10.75"), Decimal("10")),
    (Decimal("26.88"), Decimal("25")),
    (Decimal("53.75"), Decimal("50")),
)


def when_type(type_col: Column, wanted: str, value: Column) -> Column:
    """``CASE WHEN type = wanted THEN value ELSE 0 END``."""
    return F.when(type_col == F.lit(wanted), value).otherwise(F.lit(0))


def flat_revenue(fee: Column, rate: Decimal = FLAT_REVENUE_RATE) -> Column:
    return fee * F.lit(rate)


def tiered_revenue(
    fee: Column,
    tiers: Sequence[tuple[Decimal, Decimal]] = FEE_TIERS,
    rate: Decimal = FLAT_REVENUE_RATE,
) -> Column:
    """First tier whose fee equals ``fee`` wins; else ``fee * rate`` (null stays null)."""
    out: Column | None = None
    for charged, booked in tiers:
        cond = fee == F.lit(charged)
        out = F.when(cond, F.lit(booked)) if out is None else out.when(cond, F.lit(booked))
    fallback = flat_revenue(fee, rate)
    return fallback if out is None else out.otherwise(fallback)


def revenue(type_col: Column, fee: Column, rule: str) -> Column:
    """Per-row revenue for ``rule`` in {"flat", "tiered"}."""
    if rule == "flat":
        value = flat_revenue(fee)
    elif rule == "tiered":
        value = tiered_revenue(fee)
    else:
        raise ValueError(f"unknown revenue rule {rule!r}; use 'flat' or 'tiered'")
    return when_type(type_col, OUTFLOW, value)
