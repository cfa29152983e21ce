"""Date windows on landed facts: pushed bounds, month directories, whole months inside."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.dates import DateWindow
from ledgerscope.sources.tables import PARTITION_COLUMNS


def _next_month(day: dt.date) -> dt.date:
    return (day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)


def in_window(df: DataFrame, ts_col: str, window: DateWindow) -> DataFrame:
    """Rows whose ``ts_col`` lies in ``window``.

    Both bounds are literals, so a Parquet scan receives them as pushed
    filters.  When the table was landed with a month partition column, an
    implied predicate on it prunes whole directories too (exact: a
    timestamp inside the window has its month inside the months of the
    bounds).
    """
    out = df.where(window.contains(ts_col))
    for date_col, part_col in PARTITION_COLUMNS.values():
        if date_col == ts_col and part_col in df.columns and not window.is_open:
            lo = F.trunc(F.lit(window.start), "month")
            hi = F.trunc(F.lit(window.end), "month")
            out = out.where(F.col(part_col).between(lo, hi))
    return out


def whole_months(window: DateWindow) -> tuple[dt.date, dt.date] | None:
    """First and last month that lie in ``window`` with every row, or None.

    The first month is whole if the window starts on its first day (at
    midnight, the earliest row there can be).  The last month never is: its
    end day counts at midnight only.
    """
    if window.is_open or window.start > window.end:
        return None
    first = window.start if window.start.day == 1 else _next_month(window.start)
    after = window.end.replace(day=1)
    return (first, (after - dt.timedelta(days=1)).replace(day=1)) if first < after else None


def edge_rows(df: DataFrame, ts_col: str, month_col: str, window: DateWindow) -> DataFrame:
    """Rows of ``window`` that lie outside its whole months; directories of these are not read."""
    rows = in_window(df, ts_col, window)
    months = whole_months(window)
    if months is None:
        return rows
    edges = {window.end.replace(day=1)} | ({window.start.replace(day=1)} if window.start.day > 1 else set())
    return rows.where(F.col(month_col).isin(sorted(edges)))
