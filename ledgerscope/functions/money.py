"""Decimal helpers: explicit widths everywhere, never float."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.schemas import MONEY, MONEY_TOTAL, REVENUE_TOTAL


def as_money(col: Column | str, *, lenient: bool = False) -> Column:
    """Cast to ``MONEY``.  Bad text raises under ANSI mode unless ``lenient``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast(MONEY) if lenient else c.cast(MONEY)


def exact(col: Column, source_type: str, what: str) -> Column:
    """Cast to ``MONEY``, raising if the value has more decimals than it keeps.

    Floating-point sources have no exact decimals and are rounded.
    """
    scale = re.fullmatch(r"decimal\(\d+,(\d+)\)", source_type)
    if source_type != "string" and (scale is None or int(scale[1]) <= MONEY.scale):
        return col.cast(MONEY)
    wide = col.cast(T.DecimalType(38, 18))
    lost = F.raise_error(F.concat(F.lit(f"{what} has more than {MONEY.scale} decimals: "), col.cast("string")))
    return F.when(wide != wide.cast(MONEY), lost.cast(MONEY)).otherwise(wide.cast(MONEY))


def weighted(col: Column, weight: Column) -> Column:
    """``col * weight`` without losing a decimal (a plain product of wide decimals would round)."""
    return col.cast(T.DecimalType(27, 8)) * weight.cast(T.DecimalType(10, 0))


def zero_if_null(col: Column, dtype: T.DecimalType) -> Column:
    """``COALESCE(x, 0)`` with the zero typed like the result."""
    return F.coalesce(col.cast(dtype), F.lit(Decimal(0)).cast(dtype))


def money_total(col: Column) -> Column:
    return zero_if_null(col, MONEY_TOTAL)


def revenue_total(col: Column) -> Column:
    return zero_if_null(col, REVENUE_TOTAL)


def count_as_int(col: Column) -> Column:
    """Counts are ``int`` in the results; ANSI mode raises if one overflows."""
    return col.cast(T.IntegerType())
