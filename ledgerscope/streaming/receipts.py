"""Incremental ingest of receipt files with Structured Streaming.

The same source as ``ledgerscope.sources.receipts.read_receipts``, read as a
file stream: each new file in ``source_dir`` is parsed once with the
declared schema and appended to a Parquet table.  The checkpoint location
records which files were taken, so a restarted or failed job resumes
without loss or duplication (the file sink commits exactly once per batch).
``available_now`` processes what is there and stops, which suits a
scheduled job; without it the query keeps watching the directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerscope.sources.receipts import CORRUPT, receipt_schema_with_corrupt


def receipt_stream(spark: SparkSession, source_dir: str, multi_line: bool = False, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame of receipts, with the source file name and ingest time.

    ``max_files`` bounds the files of one batch (default: all that are there).
    """
    reader = (
        spark.readStream.schema(receipt_schema_with_corrupt())
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.json(source_dir)
        .withColumn("_source_file", F.col("_metadata.file_path"))
        .withColumn("_ingested_at", F.current_timestamp())
    )


def ingest_receipts(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_dir: str,
    available_now: bool = True,
    multi_line: bool = False,
    max_files: int | None = None,
) -> StreamingQuery:
    """Start appending new receipt files from ``source_dir`` to Parquet at ``target_dir``."""
    writer = (
        receipt_stream(spark, source_dir, multi_line, max_files)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(target_dir)
