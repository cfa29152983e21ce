"""Date windows for the reports.

A window is an inclusive ``BETWEEN start AND end`` on a timestamp column with
``date`` bounds, so the end day counts only at 00:00:00.  A ``None`` bound
makes the predicate unknown: no fact row passes, yet the reports still list
every assigned account (with zero flows).
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DateLike = dt.date | str | None


def parse_date(value: DateLike) -> dt.date | None:
    if value is None or isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.datetime):
        return value.date()
    return dt.date.fromisoformat(str(value).strip())


@dataclass(frozen=True)
class DateWindow:
    start: dt.date | None
    end: dt.date | None

    @classmethod
    def of(cls, start: DateLike, end: DateLike) -> "DateWindow":
        return cls(parse_date(start), parse_date(end))

    def contains(self, ts: Column | str) -> Column:
        """Inclusive range test; literal bounds so Parquet scans get both as pushed filters."""
        c = F.col(ts) if isinstance(ts, str) else ts
        return c.between(_date_lit(self.start), _date_lit(self.end))

    @property
    def is_open(self) -> bool:
        return self.start is None or self.end is None


def _date_lit(d: dt.date | None) -> Column:
    return F.lit(d) if d is not None else F.lit(None).cast(T.DateType())


def listed_months(fact: DataFrame, month_col: str = "created_month") -> list[dt.date]:
    """Months of a fact landed by month, ascending, from the paths of its files: no job runs and no file is opened.

    Rows without a date lie in a directory that names no month.  Files may be
    empty, and the rows may have been filtered since, so a month may hold no row.
    """
    found = (re.search(rf"/{month_col}=(\d{{4}}-\d\d-\d\d)/", path) for path in fact.inputFiles())
    return sorted({dt.date.fromisoformat(m[1]) for m in found if m})


def _earliest_day(transactions: DataFrame, tries: int = 3) -> dt.date | None:
    def earliest(rows: DataFrame) -> dt.date | None:
        return rows.agg(F.to_date(F.min("DateCreated")).alias("d")).first()["d"]

    if "created_month" in transactions.columns:
        for month in listed_months(transactions)[:tries]:
            # Exact: a row's month is derived from its own timestamp.
            day = earliest(transactions.where(F.col("created_month") == F.lit(month)))
            if day is not None:
                return day
    return earliest(transactions)


class _Omitted:
    def __repr__(self) -> str:
        return "<omitted>"


OMITTED = _Omitted()


def default_window(
    transactions: DataFrame,
    start: DateLike = None,
    end: DateLike | _Omitted = OMITTED,
    as_of: DateLike = None,
) -> DateWindow:
    """Fill the defaults of the development form of the assignment summary.

    * ``start`` given: kept.  ``start`` None: the date of the earliest
      ``DateCreated`` in *all* transactions; if the table is empty, 365 days
      before ``as_of``.
    * ``end`` omitted: ``as_of``.  An explicit ``None`` stays None (empty window).
    * ``as_of`` defaults to today; pass it for repeatable runs.

    The earliest date is one ``MIN`` over a single column, fetched as a scalar
    so both bounds stay literals that reach the Parquet scan.  When the table
    is landed by month (``created_month``), its file listing tells the months
    and only the earliest one with rows is scanned (see ``listed_months``).
    """
    today = parse_date(as_of) or dt.date.today()
    first = parse_date(start)
    if first is None:
        earliest = _earliest_day(transactions)
        first = earliest if earliest is not None else today - dt.timedelta(days=365)
    last = today if isinstance(end, _Omitted) else parse_date(end)
    return DateWindow(first, last)
