"""Running sums over a sorted table, without one task per key.

The table is range partitioned by (key, order), so a key with a third of all
rows is spread over many partitions.  Each partition adds up on its own while
its sorted rows stream through; then the first and the last row of each
partition tell what every partition carries in.  These two rows a partition
are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ledgerscope.llm.hashing import U, materialise

FIRST, LAST = 1, 2


def sorted_parts(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` range partitioned and sorted by ``by`` (nulls first)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def running(df: DataFrame, key: str, order: list[str], terms: list[str], name: str) -> DataFrame:
    """``df`` with ``before_t`` and ``upto_t`` for each long column ``t`` of ``terms``.

    They are the sums of ``t`` over the rows of the same ``key`` (a long, never
    null) that come earlier in ``order``, without and with the row itself.
    Sums wrap at 64 bits.  ``order`` should have no ties.
    """
    own = list(df.columns)
    sums = [f"{kind}_{t}" for t in terms for kind in ("before", "upto")]
    schema = StructType(
        list(df.schema.fields)
        + [StructField(s, LongType()) for s in sums]
        + [StructField("_part", IntegerType()), StructField("_head", BooleanType()), StructField("_edge", IntegerType())]
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key, totals, in_head, edge = None, [U(0)] * len(terms), True, FIRST
        pending: list[pa.Array] | None = None
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            if pending is not None:
                yield pa.RecordBatch.from_arrays(pending, names=schema.names)
            keys = b.column(own.index(key)).to_numpy()
            fresh = np.empty(n, bool)
            fresh[0] = last_key is None or keys[0] != last_key
            fresh[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1  # -1: still the key of the batch before
            columns = list(b.columns)
            for j, t in enumerate(terms):
                x = b.column(own.index(t)).to_numpy().view(U)
                c = np.cumsum(x, dtype=U)
                offsets = np.append(c[starts] - x[starts], U(-int(totals[j]) % (1 << 64)))  # the last one serves group -1
                upto = c - offsets[group]
                columns += [pa.array((upto - x).view(np.int64)), pa.array(upto.view(np.int64))]
                totals[j] = upto[-1]
            runs = starts[1:] if last_key is None else starts
            head = np.zeros(n, bool)
            if in_head:
                head[: runs[0] if len(runs) else n] = True
                in_head = not len(runs)
            edges = np.zeros(n, np.int32)
            edges[0], edge = edge, 0
            pending = [*columns, pa.array(np.full(n, part, np.int32)), pa.array(head), pa.array(edges)]
            last_key = keys[-1]
        if pending is not None:
            edges = pending[-1].to_numpy().copy()
            edges[-1] |= LAST
            yield pa.RecordBatch.from_arrays([*pending[:-1], pa.array(edges)], names=schema.names)

    done = materialise(sorted_parts(df, [key, *order]).mapInArrow(local, schema), name)
    upto = [f"upto_{t}" for t in terms]
    carry: dict[int, list[int]] = {}
    at, total = None, [0] * len(terms)
    for r in done.where("_edge > 0").select("_part", "_edge", "_head", F.col(key).alias("_key"), *upto).orderBy("_part", "_edge").collect():
        if r["_edge"] & FIRST:
            carry[r["_part"]] = total if r["_key"] == at else [0] * len(terms)
        if r["_edge"] & LAST:
            more = carry[r["_part"]] if r["_head"] else [0] * len(terms)
            at, total = r["_key"], [(r[u] + m) % (1 << 64) for u, m in zip(upto, more, strict=True)]
    carry = {p: c for p, c in carry.items() if any(c)}
    if not carry:
        return done.select(*own, *sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.array(sorted(carry), np.int32)
        table = np.array([carry[int(p)] for p in parts], U)
        for b in batches:
            part, head = b.column("_part").to_numpy(), b.column("_head").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(parts, part), len(parts) - 1)
            more = np.where((head & (parts[at] == part))[:, None], table[at], U(0))
            columns = [b.column(c) for c in own]
            for j, t in enumerate(terms):
                columns += [pa.array((b.column(f"{kind}_{t}").to_numpy().view(U) + more[:, j]).view(np.int64)) for kind in ("before", "upto")]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *sums])

    return done.mapInArrow(add, StructType([schema[c] for c in [*own, *sums]]))
