"""Streaming ingest of receipt files (the reports themselves are batch)."""

from ledgerscope.streaming.receipts import ingest_receipts, receipt_stream

__all__ = ["ingest_receipts", "receipt_stream"]
