"""Corpus pipeline: quality rules, near-duplicate join, decontamination, secret redaction, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its
predecessor kept; all but the last return the columns of ``documents``.  A
stage that filters leaves the documents it keeps unchanged; the secret stage
keeps every document and replaces what it finds.  Empty tables, null texts
and extra columns pass as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import decontaminate, jaccard, packing, quality, secrets
from ledgerscope.llm.common import ROWS, documents
from ledgerscope.llm.hashing import materialise
from ledgerscope.llm.queries import tokenizer_path


#: Rows of a batch that goes to a Python worker, and Spark's default; the operators take ``ROWS`` at a time anyway.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def small_batches(spark: SparkSession) -> None:
    """Batches of ``ROWS`` rows where the session names no other number: executor and worker each hold whole ones of texts."""
    key, default = ARROW_ROWS
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the divergence test."""
    small_batches(spark)
    return quality.keep(docs, quality.fit(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group of linked documents."""
    small_batches(spark)
    return jaccard.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    small_batches(spark)
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows the text where the table has it."""
    small_batches(spark)
    model = secrets.train(secrets.training_sample(docs))
    out = secrets.redact(docs, model)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the stages (tokenizer, trained models); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
