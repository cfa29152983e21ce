"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* input is a DataFrame with an id column and a text column (names are
  parameters); all other columns are ignored, so their names cannot clash;
* a null text counts as the empty text, a null id stays null;
* repeated rows are treated as separate rows, an empty table gives an empty
  result with the same schema.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The ASCII white space that separates words in every contract.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` (long), ``text`` (null becomes empty) and the columns ``keep`` only."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *keep,
    )


def crc_remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % mod


def hash_sample(df: DataFrame, key: str, max_rows: int, salt: int = 0) -> DataFrame:
    """About ``max_rows`` rows chosen by a hash of ``key``; the whole table if it is smaller.

    The choice depends on the key alone, so it repeats whatever the
    partitioning, and the expected size is bounded by ``max_rows``.
    """
    n = df.count()
    if n <= max_rows:
        return df
    share = int(max_rows / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < share)


ROWS = 1024  # rows that are turned into Python objects at once


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``ROWS`` rows (an empty batch stays)."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), ROWS):
            yield b.slice(at, ROWS)


_STATE: dict[str, object] = {"owner": None, "step": None}


def worker_state(owner: str, make: Callable[[], object]) -> object:
    """What ``make`` gave for ``owner`` in this Python worker; a new owner's state replaces the old one.

    Workers outlive jobs, so caches of operators that run one after another
    would add up otherwise (``tidy`` drops those that no later operator replaces).
    """
    if _STATE["owner"] != owner:
        _STATE.update(owner=None, value=None)
        _STATE.update(owner=owner, value=make())
    return _STATE["value"]


def begin(step: str) -> None:
    """Drop the state that another step left in this Python worker."""
    if _STATE["step"] != step:
        _STATE.update(step=step, owner=None, value=None)


def release() -> None:
    """Give memory that is free in the allocators back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, as a step of its own that leaves little memory in the Python worker.

    An executor holds several workers that outlive jobs: what other steps keep
    goes before the first batch, what this one has freed after the last.  Its own
    state stays for its next tasks.
    """
    step = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(step)
        yield from run(batches)
        release()

    return task


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str | StructType, binary: tuple[str, ...] = ()
) -> DataFrame:
    """Apply ``fn`` (columns as lists in, columns as lists out) to each Arrow batch inside the map task.

    Columns named in ``binary`` arrive as UTF-8 bytes instead of ``str``.
    """
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for b in _pieces(batches):
            cols = {}
            for name, col in zip(b.schema.names, b.columns, strict=True):
                cols[name] = (col.cast(pa.binary()) if name in binary else col).to_pylist()
            out = fn(cols)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), target)


def map_texts(df: DataFrame, text_col: str, fn: Callable[..., list[str | None]], more: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each text replaced by what ``fn`` gives for it; rows for which it gives ``None`` go.

    ``fn`` also gets the values of the columns ``more``.  It sees null texts as empty; a text that it returns unchanged stays as
    it was (null stays null).  All other columns pass through unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            k = b.schema.names.index(text_col)
            before = b.column(k).to_pylist()
            after = fn([t or "" for t in before], *(b.column(b.schema.names.index(c)).to_pylist() for c in more))
            keep = pa.array([t is not None for t in after])
            texts = [old if new is None or new == (old or "") else new for old, new in zip(before, after, strict=True)]
            columns = [pa.array(texts, b.schema.field(k).type) if i == k else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(keep)

    return df.mapInArrow(tidy(run), df.schema)
