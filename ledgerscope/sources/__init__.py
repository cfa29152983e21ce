"""Where the seven tables and the receipts come from."""

from ledgerscope.sources.fixture import fixture_tables
from ledgerscope.sources.receipts import parse_receipts, read_receipts
from ledgerscope.sources.tables import (
    Tables,
    conform,
    read_catalog_tables,
    read_jdbc_tables,
    read_parquet_tables,
    write_tables,
)

__all__ = [
    "Tables",
    "conform",
    "fixture_tables",
    "parse_receipts",
    "read_catalog_tables",
    "read_jdbc_tables",
    "read_parquet_tables",
    "read_receipts",
    "write_tables",
]
