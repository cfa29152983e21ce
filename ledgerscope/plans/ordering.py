"""Caller-chosen result order.

Sort keys come as two parallel lists, field names and directions.  A
direction is ascending only when it is exactly ``"A"``; anything else,
including a missing entry, is descending.  Extra directions are ignored.
Nulls go last when ascending and first when descending (the order the
reports' database uses), written out explicitly on every key because
Spark's defaults are the reverse.  Field names are output column names,
matched without regard to case; an unknown name is an error that lists the
allowed ones.  Text compares by bytes, not by a database collation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _resolve(name: str, columns: Sequence[str]) -> str:
    lookup = {c.lower(): c for c in columns}
    found = lookup.get(str(name).lower()) if name is not None else None
    if found is None:
        raise ValueError(f"cannot sort by {name!r}; sortable columns: {', '.join(columns)}")
    return found


def sort_columns(
    columns: Sequence[str],
    fields: Sequence[str] | None,
    dirs: Sequence[str | None] | None,
) -> list[Column] | None:
    """Sort expressions for (``fields``, ``dirs``), or None when no order was asked for.

    No order means: either list is None, or ``fields`` is empty.
    """
    if fields is None or dirs is None or len(fields) == 0:
        return None
    out = []
    for i, name in enumerate(fields):
        col = F.col(_resolve(name, columns))
        ascending = i < len(dirs) and dirs[i] == "A"
        out.append(col.asc_nulls_last() if ascending else col.desc_nulls_first())
    return out


def order_result(
    df: DataFrame,
    fields: Sequence[str] | None,
    dirs: Sequence[str | None] | None,
    default: Sequence[Column] | None = None,
) -> DataFrame:
    """Apply the caller's order, else ``default`` (None leaves the result unordered)."""
    keys = sort_columns(df.columns, fields, dirs)
    if keys is None:
        keys = list(default) if default else None
    return df.orderBy(*keys) if keys else df


def ascending(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def descending(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def with_position(df: DataFrame, keys: Sequence[Column], name: str = "position") -> DataFrame:
    """Number the rows 1..n in the order of ``keys`` without one-task windows.

    The sort is range partitioned across tasks and checkpointed (reliably, to
    the session's checkpoint directory), so each partition's rows and their
    order are fixed.  A row's position is its index inside its partition
    plus the row count of all earlier partitions; that offset table has one
    row per partition, a size bounded by the partition count, so it is safe
    to broadcast.  Give ``keys`` a full tie-break for a unique numbering.
    """
    from ledgerscope.config import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    fixed = df.orderBy(*keys).checkpoint(eager=True)
    tagged = fixed.withColumn("_mid", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright(F.col("_mid"), 33).alias("_part"),
        (F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("_idx"),
    )
    from pyspark.sql.window import Window

    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_part",
        (F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    )
    return (
        tagged.join(F.broadcast(offsets), "_part", "left")
        .withColumn(name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_idx") + 1).cast("long"))
        .drop("_mid", "_part", "_idx", "_off")
    )
