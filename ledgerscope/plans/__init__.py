"""The two reports and their ordering."""

from ledgerscope.plans.assignment import (
    assignment_rows,
    assignment_summary,
    assignment_summary_with_defaults,
)
from ledgerscope.plans.ordering import order_result, sort_columns, with_position
from ledgerscope.plans.salesperson import sales_person_rows, sales_person_summary

__all__ = [
    "assignment_rows",
    "assignment_summary",
    "assignment_summary_with_defaults",
    "order_result",
    "sales_person_rows",
    "sales_person_summary",
    "sort_columns",
    "with_position",
]
