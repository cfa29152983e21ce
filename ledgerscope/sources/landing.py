"""Incremental landing: new months and late rows, without rewriting the rest.

Facts landed by ``write_tables`` lie in one directory per month (and key
bucket).  A batch touches only the directories of its own rows: these are
written anew by dynamic partition overwrite, all others keep their files.
Roll-ups of the touched months, where there are any, follow.

Two kinds of batch:

* ``"replace"``: the batch holds its months whole (a new month, or one sent again).
  Landing it twice gives the same result.
* ``"add"``: the batch holds further rows of months that may exist already (late
  rows).  The directories they belong to are read, extended and replaced in one write;
  an interrupted landing can be repeated, a finished one must not be.
"""

from __future__ import annotations

import os
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources.rollups import ROLLUPS, monthly
from ledgerscope.sources.tables import PARTITION_COLUMNS, arranged, bucket_column, conform, lay_out, stored

KINDS = ("replace", "add")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # directory of rows whose partition value is null


def _buckets_of(existing: DataFrame | None, buckets: int | None) -> int:
    bucket = bucket_column(existing) if existing is not None else None
    there = int(bucket.rsplit("_", 1)[1]) if bucket else 0
    if existing is not None and buckets is not None and buckets != there:
        raise ValueError(f"the table was landed with {there} buckets, not {buckets}")
    return there if existing is not None else buckets or 0


def _overwrite(df: DataFrame, name: str, by: list[str], path: str) -> None:
    """Replace the partitions that ``df`` has rows in, and no others."""
    arranged(df, name, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _drop(spark: SparkSession, path: str, stale: set[tuple[str, ...]]) -> None:
    """Remove partition directories, given as their ``name=value`` parts."""
    for parts in sorted(stale):
        p = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, *parts))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _parts(df: DataFrame, by: list[str]) -> set[tuple[str, ...]]:
    """Partition directories of rows: one per (month, bucket) at most."""
    named = lambda c, v: f"{c}={NO_VALUE if v is None else v}"
    return {tuple(named(c, r[c]) for c in by) for r in df.select(*by).distinct().collect()}


def land_batch(spark: SparkSession, batch: DataFrame, name: str, root: str, kind: str = "replace", buckets: int | None = None) -> list:
    """Land ``batch`` of fact ``name`` under ``root``; returns the months it touched.

    ``buckets`` is needed for the first batch only.  Rows without a date are
    landed in the directory of no month.
    """
    if name not in PARTITION_COLUMNS:
        raise ValueError(f"{name} is not a fact; facts are {', '.join(PARTITION_COLUMNS)}")
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    path = os.path.join(root, name)
    old = stored(spark, path)
    landed, by = lay_out(conform(batch, name), name, _buckets_of(old, buckets))
    month = by[0]
    months = sorted((r[0] for r in landed.select(month).distinct().collect()), key=str)
    if not months:
        return []
    known = [m for m in months if m is not None]
    of_months = F.col(month).isin(known) | (F.col(month).isNull() if None in months else F.lit(False))
    gone: set[tuple[str, ...]] = set()
    if old is not None and kind == "add":
        mine = landed.select(*by).distinct().alias("t")
        same = reduce(and_, (F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by))
        landed = landed.unionByName(old.where(of_months).alias("o").join(mine, same, "left_semi").select(*landed.columns))
    elif old is not None:
        gone = _parts(old.where(of_months), by) - _parts(landed, by)
    _overwrite(landed, name, by, path)
    _drop(spark, path, gone)
    for rollup, fact in ROLLUPS.items():
        target = os.path.join(root, rollup)
        summed = stored(spark, target) if fact == name else None
        if summed is not None:
            fresh = conform(spark.read.parquet(path), name).where(of_months)
            gone = _parts(summed.where(of_months), by) - _parts(fresh, by)
            _overwrite(monthly(fresh, rollup), rollup, by, target)
            _drop(spark, target, gone)
    return months
