"""Hard negatives from Hilbert-ordered blocks with zone maps.

An anchor's positives are the rows of its label with the highest inner
products; its hard negatives for a positive are the rows of other labels whose
score lies in a window just below the positive's.

Blocks.  Components are quantised to integers, rows sorted along a Hilbert
curve over the dimensions (range partitioning, ties by id), and written as
Parquet, one record per block of ``BLOCK_ROWS`` rows, with the least and
greatest value of each dimension.  The blocks of one range partition share a directory.

Bounds.  For an anchor a, the products of a block's rows lie between the sums
of min(a * lo, a * hi) and of max(a * lo, a * hi) over the dimensions.  A pass
over the zone maps alone (two of the columns) picks the blocks in which some
window needs a row; only these are read, and each meets only the
anchors whose windows need it.

Windows.  Each anchor's own block, its neighbourhood on the curve, is searched first.  The
k-th best score found there is a lower limit of the final k-th best, so the
window [limit, top] that the bounds are held against is narrow before the
other blocks are chosen.  Limits rise further while a task goes through its blocks.

Anchors go through in groups of about ``ANCHORS_AT_ONCE``; a group and its
windows are all that the driver and the broadcasts hold.  Tasks emit the best few rows of
each window, never pairs.

Defined cases: rows without an id, without a label or without a vector, or with
a null, NaN or infinite component take no part.  Shorter vectors (an empty one
too) count as if zeros followed.  Quantised components beyond +-2**26 are cut to that, so that scores fit a
long up to 1024 dimensions.  Equal scores go by smaller id; repeated rows are rows of their own,
and an anchor row is never its own positive.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.hashing import materialise, shared_path

BLOCK_ROWS = 1024
ANCHORS_AT_ONCE = 32_768
TILE = 512  # anchors compared with a block at once
KEY_BITS = 256  # of a curve position, over all dimensions
MAX_PICKED = 1_000_000  # chosen blocks that are broadcast (16 MB); more are joined by shuffle
LEAST = np.iinfo(np.int64).min
SCALE, CUT = 256, 1 << 26


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve, as rows of bytes, of points with ``bits``-bit coordinates (Skilling's transform)."""
    x = x.astype(np.uint32).T.copy()
    dims = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:  # undo the rotations of the sub-cubes
        p = q - np.uint32(1)
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            if i:
                x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - np.uint32(1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def quantised(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Integer components of a list column, filled with zeros to ``dims``."""
    values = np.clip(np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64)), -CUT, CUT).astype(np.int32)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(column), dims if dims is not None else int(sizes.max(initial=0))), np.int32)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[rows, :n] = values[offsets[rows][:, None] + np.arange(n)]
    return out


# --------------------------------------------------------------------------
# candidate blocks


def participants(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``row, vec_id, label, vec`` of the rows that take part; ``row`` numbers them."""
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(good)
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "vectors")


def ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest quantised value of each dimension over all rows (a row that lacks a dimension is not asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.zeros(0, np.int32), np.zeros(0, np.int32)
        for b in batches:
            if b.num_rows:
                q = quantised(b.column(0))
                wide = max(len(lo), q.shape[1])
                a, z = (np.concatenate([v, np.zeros(wide - len(v), np.int32)]) for v in (lo, hi))
                q = np.pad(q, ((0, 0), (0, wide - q.shape[1])))
                lo, hi = np.minimum(a, q.min(0)), np.maximum(z, q.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo), pa.array(hi)], names=["dim", "lo", "hi"])

    found = rows.select("vec").mapInArrow(run, "dim int, lo int, hi int").groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").collect()
    return np.array([r["lo"] for r in found], np.int64), np.array([r["hi"] for r in found], np.int64)


BLOCKS = "zone int, block long, lo binary, hi binary, row binary, vec_id binary, label binary, vec binary"


def blocks(rows: DataFrame, lo: np.ndarray, hi: np.ndarray, block_rows: int) -> DataFrame:
    """The rows as Parquet blocks along the Hilbert curve, a directory (``zone``) per range partition."""
    dims = len(lo)
    bits = max(1, min(8, KEY_BITS // max(1, dims)))
    curve = np.sort(np.argsort(lo - hi, kind="stable")[: KEY_BITS // bits])  # the widest dimensions

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                piece = b.slice(at, 4096)
                q = quantised(piece.column("vec"), dims)
                cells = (q[:, curve] - lo[curve]) * (1 << bits) // (hi - lo + 1)[curve]
                key = hilbert(cells, bits) if dims else np.zeros((len(q), 1), np.uint8)
                binary = [pa.array([v.tobytes() for v in x], pa.binary()) for x in (key, q)]
                yield pa.RecordBatch.from_arrays([binary[0], *piece.columns[:3], binary[1]], names=["key", "row", "vec_id", "label", "q"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, number, rest = TaskContext.get().partitionId(), 0, []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            rows = sorted(rows, key=lambda r: (r[1], r[0]))
            row, vec_id, label = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            q = np.frombuffer(b"".join(r[3] for r in rows), np.int32).reshape(len(rows), dims)
            parts = [q.min(0), q.max(0), row, vec_id, label, q]
            return pa.RecordBatch.from_arrays(
                [pa.array([zone], pa.int32()), pa.array([(zone << 32) + number]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=[f.split()[0] for f in BLOCKS.split(", ")]
            )

        for b in batches:
            rest.extend(zip(*(b.column(c).to_pylist() for c in ("row", "vec_id", "label", "q")), strict=True))
            while len(rest) >= block_rows:
                yield block(rest[:block_rows])
                rest, number = rest[block_rows:], number + 1
        if rest:
            yield block(rest)

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.mapInArrow(keyed, "key binary, row long, vec_id long, label long, q binary")
    curve_order = keys.repartitionByRange(parts, "key", "vec_id", "row").sortWithinPartitions("key", "vec_id", "row")
    path = shared_path(spark, "blocks")
    curve_order.mapInArrow(packed, BLOCKS).write.partitionBy("zone").parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


# --------------------------------------------------------------------------
# searching blocks


@dataclass
class Windows:
    """Score windows of a group of anchors: for each, the best ``k`` rows so far.

    ``of`` is the anchor's place of each window; ``low`` and ``top`` limit its scores.
    """

    row: np.ndarray  # anchors, ordered by row number
    label: np.ndarray
    q: np.ndarray
    same: bool  # rows of the anchor's label are wanted, else of other labels
    of: np.ndarray
    low: np.ndarray
    top: np.ndarray
    k: int

    def start(self) -> None:
        self.best = np.zeros((0, 4), np.int64)  # window, score, vec_id, row: at most k per window

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible product of each anchor with a row of a block."""
        up, down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        return up @ lo + down @ hi, up @ hi + down @ lo

    def wanted(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Windows that a block with this zone map may hold a row for."""
        least, most = self.bounds(lo, hi)
        return np.flatnonzero((most[self.of] >= self.low) & (least[self.of] <= self.top))

    def search(self, block: dict[str, np.ndarray], windows: np.ndarray) -> None:
        """Take in the rows of a block for some windows."""
        for at in range(0, len(windows), TILE):
            w = windows[at : at + TILE]
            anchors, place = np.unique(self.of[w], return_inverse=True)
            scores = (self.q[anchors] @ block["vec"].T)[place].astype(np.int64)
            own = self.of[w]
            fits = (scores >= self.low[w, None]) & (scores <= self.top[w, None])
            fits &= (block["label"] == self.label[own, None]) == self.same
            if self.same:
                fits &= block["row"] != self.row[own, None]
            if fits.shape[1] > self.k:
                masked = np.where(fits, scores, LEAST)
                fits &= masked >= np.partition(masked, -self.k, axis=1)[:, [-self.k]]
            a, b = np.nonzero(fits)
            if len(a):
                self.take(np.column_stack([w[a], scores[a, b], block["vec_id"][b], block["row"][b]]))

    def take(self, found: np.ndarray) -> None:
        """Merge rows into the best ones and raise the limits of the windows that are full."""
        touched = np.isin(self.best[:, 0], found[:, 0])
        rows = np.concatenate([self.best[touched], found])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        rows, rank = rows[rank < self.k], rank[rank < self.k]
        last = rows[rank == self.k - 1]
        self.low[last[:, 0]] = np.maximum(self.low[last[:, 0]], last[:, 1])
        self.best = np.concatenate([self.best[~touched], rows])


def _arrays(b: pa.RecordBatch, i: int, kind) -> dict[str, np.ndarray]:
    out = {c: np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("row", "vec_id", "label")}
    out["vec"] = np.frombuffer(b.column("vec")[i].as_py(), np.int32).reshape(len(out["row"]), -1).astype(kind)
    return out


def _zone(b: pa.RecordBatch, i: int, kind) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = (np.frombuffer(b.column(c)[i].as_py(), np.int32).astype(kind) for c in ("lo", "hi"))
    return lo, hi


FOUND = "win long, score long, vec_id long, row long"


def search(table: DataFrame, windows: Windows, own_block: bool) -> DataFrame:
    """The best rows of each window: over its anchor's own block, or over all blocks its bounds ask for."""
    import copy

    shared = table.sparkSession.sparkContext.broadcast(windows)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            keep = [len(w.wanted(*_zone(b, i, w.q.dtype))) > 0 for i in range(b.num_rows)]
            yield b.select(["zone", "block"]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = copy.copy(shared.value)
        w.low = w.low.copy()
        w.start()
        for b in batches:
            for i in range(b.num_rows):
                if own_block:
                    rows = np.frombuffer(b.column("row")[i].as_py(), np.int64)
                    which = np.flatnonzero(np.isin(w.row[w.of], rows))
                else:
                    which = w.wanted(*_zone(b, i, w.q.dtype))
                if len(which):
                    w.search(_arrays(b, i, w.q.dtype), which)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w.best[:, c])) for c in range(4)], names=["win", "score", "vec_id", "row"])

    if not own_block:
        picked = materialise(table.select("zone", "block", "lo", "hi").mapInArrow(pick, "zone int, block long"), "picked")
        few = picked.count() <= MAX_PICKED
        table = table.join(F.broadcast(picked) if few else picked, ["zone", "block"], "left_semi")
    found = table.mapInArrow(run, FOUND)
    order = Window.partitionBy("win").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.k)


def best(table: DataFrame, windows: Windows) -> DataFrame:
    """The ``k`` best rows of each window over the whole table."""
    near = search(table, windows, own_block=True).where(F.col("rank") == windows.k).select("win", "score").toArrow()
    win, score = (near.column(c).to_numpy() for c in ("win", "score"))
    windows.low[win] = np.maximum(windows.low[win], score)
    return search(table, windows, own_block=False)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mine_group(table: DataFrame, anchors: pa.Table, kind, lo: np.ndarray, positives: int, negatives: int, percent: int) -> DataFrame:
    anchors = anchors.sort_by("row").combine_chunks()
    row, label, ids = (anchors.column(c).to_numpy() for c in ("row", "label", "vec_id"))
    column = anchors.column("vec")
    q = quantised(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, len(lo)).astype(kind)
    n = len(row)
    every = Windows(row, label, q, True, np.arange(n), np.full(n, LEAST), np.full(n, np.iinfo(np.int64).max), positives)
    pos = best(table, every).select("win", "rank", "vec_id", "score").orderBy("win", "rank").toArrow()
    win, pid, top = (pos.column(c).to_numpy() for c in ("win", "vec_id", "score"))
    low = np.array([-(-percent * int(p) // 100) for p in top], np.int64)
    ranges_ = Windows(row, label, q, False, win, low, top.copy(), negatives)
    found = best(table, ranges_)
    spark = table.sparkSession
    pairs = pa.table({"win": np.arange(len(win)), "anchor_id": ids[win], "positive_id": pid, "positive_score": top})
    named = found.join(F.broadcast(spark.createDataFrame(pairs)), "win")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
    percent: int = 80, block_rows: int = BLOCK_ROWS, anchors_at_once: int = ANCHORS_AT_ONCE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``is_anchor`` (over ``vec_id``) holds.  The
    negatives of a positive with score p are the first rows of other labels with ``percent`` * p <= 100 * score <= 100 * p.
    """
    spark = vectors.sparkSession
    rows = participants(vectors, id_col, vector_col, label_col)
    chosen = rows.where(is_anchor)
    count = chosen.count()
    if not count:
        return spark.createDataFrame([], RESULT)
    lo, hi = ranges(rows)
    table = blocks(rows, lo, hi, block_rows)
    largest = int(max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)))
    kind = np.float64 if largest * largest * max(1, len(lo)) < 1 << 53 else np.int64  # both exact
    groups = -(-count // anchors_at_once)
    path = shared_path(spark, "negatives")
    group = F.pmod(F.xxhash64("row"), F.lit(groups))
    for g in range(groups):
        anchors = chosen.where(group == g).select("row", "vec_id", "label", "vec").toArrow()
        if anchors.num_rows:
            _mine_group(table, anchors, kind, lo, positives, negatives, percent).write.parquet(f"{path}/group={g}")
    return spark.read.schema(RESULT).option("basePath", path).parquet(path).select(*[f.split()[0] for f in RESULT.split(", ")])
