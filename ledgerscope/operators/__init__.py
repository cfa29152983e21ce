"""Report stages and the size-checked pruning around them."""

from ledgerscope.operators.stages import (
    ALL,
    account_holders,
    account_owners,
    assigned_accounts,
    assigned_balances,
    assignment_counts,
    balance_weights,
    balances_by_email,
    credits_per_account,
    holder_inflow,
    in_window,
    inflow,
    owner_inflow,
    replicate,
    resolve_accounts,
    transactions_breakdown,
    weighted_balance_rows,
)

__all__ = [
    "ALL",
    "account_holders",
    "account_owners",
    "assigned_accounts",
    "assigned_balances",
    "assignment_counts",
    "balance_weights",
    "balances_by_email",
    "credits_per_account",
    "holder_inflow",
    "in_window",
    "inflow",
    "owner_inflow",
    "replicate",
    "resolve_accounts",
    "transactions_breakdown",
    "weighted_balance_rows",
]
