"""Transfer receipts: flat JSON objects, one per receipt.

Always read with the declared ``RECEIPT`` schema: inference would turn money
into ``double`` and all-null fields into ``string``.  Malformed records are
kept in ``_corrupt_record`` rather than dropped, so a bad file is visible.
Receipts are a different domain from ``Transactions``: their
``TransactionType`` is a transfer channel, so they are never unioned into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.schemas import RECEIPT

CORRUPT = "_corrupt_record"


def receipt_schema_with_corrupt() -> T.StructType:
    return T.StructType(RECEIPT.fields + [T.StructField(CORRUPT, T.StringType(), True)])


def read_receipts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Batch-read receipt files: JSON lines, which split between tasks.

    ``multi_line`` reads pretty-printed objects instead; each file is then one task.

    Spark refuses a query whose only column is ``_corrupt_record``; select
    it together with another column (or land the result first).
    """
    return (
        spark.read.schema(receipt_schema_with_corrupt())
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def parse_receipts(json_text: Column | str) -> Column:
    """Parse a receipt held as JSON text in a column; the result is a struct.

    Its last field, ``_corrupt_record``, holds the text of a record that does
    not parse as a whole; the fields that do parse are kept.
    """
    c = F.col(json_text) if isinstance(json_text, str) else json_text
    return F.from_json(c, receipt_schema_with_corrupt(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
