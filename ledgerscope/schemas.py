"""Declared schemas: the seven source tables, both report results, the receipt.

The source tables have no published DDL; their columns are known from use.
Money lands as ``decimal(20,6)``: the reports sum unrounded amounts, so rows
keep up to six decimals (a source with more raises instead of rounding).
Report outputs widen to ``decimal(38,6)`` for money and ``decimal(38,8)`` for
revenue (a fee times a rate of two decimals), so sums of sums never round.
Weighted sums allow totals below 10**19 and weights below 10**10
(``functions.money.weighted``).  Counts are ``int``.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 6)
MONEY_TOTAL = T.DecimalType(38, 6)
REVENUE_TOTAL = T.DecimalType(38, 8)

TABLE_NAMES = (
    "sales_assigned_accounts",
    "customers",
    "businesses",
    "accounts",
    "transactions",
    "post_credit_transactions",
    "daily_balances",
)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), True) for n in names]


SALES_ASSIGNED_ACCOUNTS = T.StructType(
    _strings("SalesPersonCode", "AssignedTo", "Email", "AccountName", "PhoneNumber", "AccountHolder")
)
CUSTOMERS = T.StructType(_strings("Id", "UserName"))
BUSINESSES = T.StructType(_strings("Id", "Email"))
ACCOUNTS = T.StructType(_strings("AccountNumber", "CustomerId", "BusinessId"))
TRANSACTIONS = T.StructType(
    _strings("EmailAddress", "TransactionType")
    + [
        T.StructField("Amount", MONEY, True),
        T.StructField("TransactionFee", MONEY, True),
        T.StructField("DateCreated", T.TimestampNTZType(), True),
    ]
)
POST_CREDIT_TRANSACTIONS = T.StructType(
    _strings("BeneficiaryAccountNumber")
    + [
        T.StructField("Amount", MONEY, True),
        T.StructField("RequestDate", T.TimestampNTZType(), True),
    ]
)
# BalanceDate is ours: the reports never read it (a balance row is not picked
# by date), but a landed table needs it for layout and for audits.
DAILY_BALANCES = T.StructType(
    _strings("UserName", "AccountHolder")
    + [
        T.StructField("TotalLedgerBalance", MONEY, True),
        T.StructField("TotalAvailableBalance", MONEY, True),
        T.StructField("BalanceDate", T.DateType(), True),
    ]
)

TABLE_SCHEMAS = {
    "sales_assigned_accounts": SALES_ASSIGNED_ACCOUNTS,
    "customers": CUSTOMERS,
    "businesses": BUSINESSES,
    "accounts": ACCOUNTS,
    "transactions": TRANSACTIONS,
    "post_credit_transactions": POST_CREDIT_TRANSACTIONS,
    "daily_balances": DAILY_BALANCES,
}

# Columns that a source may lack; they are then null.
OPTIONAL_COLUMNS = {"daily_balances": ("BalanceDate",)}

# Result of the assignment summary (one row per assigned account and balance row).
ASSIGNMENT_SUMMARY = T.StructType(
    _strings("email", "accountname", "phonenumber", "accountholder")
    + [
        T.StructField("totaloutflow", MONEY_TOTAL, True),
        T.StructField("totalinflow", MONEY_TOTAL, True),
        T.StructField("totalfees", MONEY_TOTAL, True),
        T.StructField("totalrevenue", REVENUE_TOTAL, True),
        T.StructField("totalledgerbalance", MONEY_TOTAL, True),
        T.StructField("totalavailablebalance", MONEY_TOTAL, True),
    ]
)

# Result of the sales-person summary (one row per sales person and assignee).
SALES_PERSON_SUMMARY = T.StructType(
    _strings("salespersoncode", "assignedto")
    + [
        T.StructField("totalnumberofaccounts", T.IntegerType(), True),
        T.StructField("totaloutflow", MONEY_TOTAL, True),
        T.StructField("totalinflow", MONEY_TOTAL, True),
        T.StructField("totalfees", MONEY_TOTAL, True),
        T.StructField("totalrevenue", REVENUE_TOTAL, True),
        T.StructField("numberofbusiness", T.IntegerType(), True),
        T.StructField("numberofcustomers", T.IntegerType(), True),
        T.StructField("totalledgerbalance", MONEY_TOTAL, True),
        T.StructField("totalavailablebalance", MONEY_TOTAL, True),
    ]
)

# A flat transfer receipt (one JSON object per receipt).  Money is declared
# decimal: inference would read it as double, and all-null fields as string.
RECEIPT = T.StructType(
    [
        T.StructField("Message", T.StringType(), True),
        T.StructField("Reference", T.StringType(), True),
        T.StructField("UserId", T.StringType(), True),
        T.StructField("ResponseCode", T.StringType(), True),
        T.StructField("SessionId", T.StringType(), True),
        T.StructField("ProviderReference", T.StringType(), True),
        T.StructField("ShouldSaveBeneficiary", T.BooleanType(), True),
        T.StructField("AccountNumber", T.StringType(), True),
        T.StructField("NameEnquiryId", T.LongType(), True),
        T.StructField("AccountName", T.StringType(), True),
        T.StructField("BankCode", T.StringType(), True),
        T.StructField("EmailAddress", T.StringType(), True),
        T.StructField("BankId", T.LongType(), True),
        T.StructField("BankName", T.StringType(), True),
        T.StructField("FirstName", T.StringType(), True),
        T.StructField("TransferType", T.LongType(), True),
        T.StructField("WalletId", T.LongType(), True),
        T.StructField("SourceWallet", T.StringType(), True),
        T.StructField("SourceWalletCurrency", T.StringType(), True),
        T.StructField("Amount", MONEY, True),
        T.StructField("Charges", MONEY, True),
        T.StructField("ChargeType", T.StringType(), True),
        T.StructField("ExchangeRateAmount", MONEY, True),
        T.StructField("TransactionReference", T.StringType(), True),
        T.StructField("SourceWalletAccountName", T.StringType(), True),
        T.StructField("SourceWalletAccountNumber", T.StringType(), True),
        T.StructField("PhoneNumber", T.StringType(), True),
        T.StructField("ExchangeRateMultiplier", T.DecimalType(18, 6), True),
        T.StructField("DestinationBank", T.StringType(), True),
        T.StructField("ReceiverEmail", T.StringType(), True),
        T.StructField("DestinationUserId", T.StringType(), True),
        T.StructField("DestinationPhoneNumber", T.StringType(), True),
        T.StructField("Narration", T.StringType(), True),
        T.StructField("HasBeneficiary", T.BooleanType(), True),
        T.StructField("SourceWalletBalance", MONEY, True),
        T.StructField("DestinationWalletBalance", MONEY, True),
        T.StructField("TransactionType", T.StringType(), True),
    ]
)


def check_shape(actual: T.StructType, expected: T.StructType) -> None:
    """Raise unless column names and types match ``expected`` (nullability aside)."""
    got = [(f.name, f.dataType) for f in actual.fields]
    want = [(f.name, f.dataType) for f in expected.fields]
    if got != want:
        raise TypeError(f"result schema {got} differs from the declared {want}")
