"""ledgerscope: sales-portfolio reports on Spark.

Two reports over seven bank tables -- an assignment summary for one sales
person and a summary per sales person -- built from DataFrame stages.
"""

from ledgerscope.functions.dates import OMITTED, DateWindow, default_window
from ledgerscope.plans import (
    assignment_summary,
    assignment_summary_with_defaults,
    sales_person_summary,
    with_position,
)
from ledgerscope.sources import Tables, fixture_tables, read_parquet_tables, write_tables

__all__ = [
    "OMITTED",
    "DateWindow",
    "Tables",
    "assignment_summary",
    "assignment_summary_with_defaults",
    "default_window",
    "fixture_tables",
    "read_parquet_tables",
    "sales_person_summary",
    "with_position",
    "write_tables",
]
