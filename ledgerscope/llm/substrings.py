"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every string of ``length`` bytes that starts at two or more places of the
collection is repeated; all bytes that some repeated string covers go.

Suffixes are ordered by most-significant-digit passes that stop at ``length``
bytes: each pass splits the suffixes by one more digit and keeps only those
that still share all digits so far with another one; the groups left at full
depth are exactly the repeated strings.  A digit is a 64-bit hash of a byte
run, as only equality of groups matters.

1. First digit.  A string's digit is the ``GRAM`` bytes with the least hash
   inside it, with their place in it; it depends on the string alone, so equal
   strings have equal digits.  Neighbouring strings mostly have the same gram, so a text has only
   about two grams per (``length`` - ``GRAM``) bytes, and one record stands
   for the run of strings that have it.  Grams that occur once end here.
2. Second digit: all bytes of the run of strings.  Runs that agree here are
   repeated as a whole.
3. Third digit, only where the runs of one gram differ (the borders of
   repeated passages), for one representative of each distinct run: the bytes
   that ``BLOCK`` neighbouring strings of the run have in common.  Blocks of
   which these bytes occur once end here; blocks that agree in all bytes of
   their strings are repeated as a whole.
4. Fourth digit, only where blocks with the same common bytes differ, again
   for one representative of each: the full ``length`` bytes, string by string.

No group is gathered in any pass: a unit is one row with two hashes, counts
are aggregated before the shuffle and joined back, and AQE splits what a hot
digit makes large.

Defined cases: null and empty texts, and texts shorter than ``length``, lose
nothing; equal rows count as two places; a row without an id is
known by its text; rows that repeat an id must repeat the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import id_and_text, map_batches
from ledgerscope.llm.hashing import Spans, U, materialise, mix, slices

GRAM = 64
BLOCK = 16  # neighbouring strings of a run that the third digit takes together
SLICE = 2_000_000  # bytes of text handled at once
MAX_IDS = 1_000_000  # node ids that are broadcast (8 MB); more are joined by shuffle
_PLACE = U((1 << 28) - 1)  # low bits of a key that hold the place in the slice


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, U)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings that share their gram: text index, gram hash, run hash, first start, number, gram offset."""
    data, starts = _buffer(texts)
    empty = tuple(np.zeros(0, t) for t in (np.int64, U, U, np.int64, np.int64, np.int64))
    if len(data) < length:
        return empty
    if len(data) > int(_PLACE):
        raise ValueError("a text is longer than 256 MB")
    inside = np.zeros(len(data) - length + 1, bool)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    spans = Spans(data)
    grams = spans.fixed(GRAM)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
    anchor = (_sliding_min(keys, length - GRAM + 1)[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
    lo, p = at[new], anchor[new]
    count = np.diff(np.concatenate((new, [len(at)])))
    text = np.searchsorted(starts, lo, side="right") - 1
    run = spans.of(lo, lo + count - 1 + length) ^ (p - lo).astype(U)
    return text, grams[p], run, lo - starts[text], count, p - lo


RUNS = "gram long, run long, node long, place long"  # place: start, number of strings, gram offset


def _runs(texts: DataFrame, length: int) -> DataFrame:
    def batches(it):
        for b in it:
            nodes, data = b.column(0).to_numpy(zero_copy_only=False), b.column(1).cast(pa.binary()).to_pylist()
            for x, y in slices(data, SLICE):
                text, gram, run, lo, count, off = runs_of(data[x:y], length)
                place = (lo << 16) | (count << 8) | off
                cols = [gram.view(np.int64), run.view(np.int64), nodes[x:y][text].astype(np.int64), place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "run", "node", "place"])

    return texts.mapInArrow(batches, RUNS)


BORDERS = "gram long, off int, node long, lo long, data binary"


def only(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of the given nodes (one column)."""
    nodes = nodes.distinct()
    return texts.join(F.broadcast(nodes) if nodes.count() <= MAX_IDS else nodes, "node", "left_semi")


def _borders(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs, and the offset of the gram in their first string."""
    lists = wanted.groupBy("node").agg(F.collect_list(F.struct("gram", "place")).alias("runs"))  # at most one text's runs
    joined = only(texts, wanted.select("node")).dropDuplicates(["node"]).join(lists, "node")
    joined = joined.select("node", "text", F.col("runs.gram").alias("grams"), F.col("runs.place").alias("places"))

    def batch(cols):
        rows = []
        for node, text, grams, places in zip(cols["node"], cols["text"], cols["grams"], cols["places"], strict=True):
            for gram, place in zip(grams, places, strict=True):
                lo, count, off = place >> 16, (place >> 8) & 255, place & 255
                rows.append((gram, off, node, lo, text[lo : lo + count - 1 + length]))
        names = ("gram", "off", "node", "lo", "data")
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else None

    return map_batches(joined, batch, BORDERS, binary=("text",))


def blocks_of(gram: np.ndarray, off: np.ndarray, data: list[bytes], length: int, step: int) -> tuple[np.ndarray, ...]:
    """Runs cut into blocks of strings: run index, hash of the bytes common to a full block, hash of all bytes, first string, number, gram offset.

    Cuts depend on a string's gram offset alone, so equal strings of two runs lie in blocks with equal common bytes.
    """
    buffer, starts = _buffer(data)
    spans = Spans(buffer)
    count = np.diff(starts) - length + 1  # strings of each run
    k = np.repeat(np.arange(len(data)), count)
    i = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    block = (off[k] - i) // step
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (block[1:] != block[:-1]))))
    k, i, block, number = k[new], i[new], block[new], np.diff(np.concatenate((new, [len(block)])))
    near, far = block * step, np.minimum(block * step + step - 1, length - GRAM)  # gram offsets of a full block's strings
    at = starts[k] + off[k]
    common = mix(spans.of(at - near, at - far + length) ^ mix(gram.view(U)[k] + near.astype(U)))
    first = starts[k] + i
    return k, common, spans.of(first, first + number - 1 + length) ^ mix((off[k] - i).astype(U)), i, number, off[k] - i


def _blocks(borders: DataFrame, length: int, step: int) -> DataFrame:
    """The blocks of border runs, as runs."""

    def batches(it):
        for b in it:
            gram, off, node, lo = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
            data = b.column(4).to_pylist()
            for x, y in slices(data, SLICE // 8):  # a run has about a string for two bytes
                k, common, run, i, number, first = blocks_of(gram[x:y], off[x:y], data[x:y], length, step)
                place = ((lo[x:y][k] + i) << 16) | (number << 8) | first
                cols = [common.view(np.int64), run.view(np.int64), node[x:y][k], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "run", "node", "place"])

    return borders.select("gram", "off", "node", "lo", "data").mapInArrow(batches, RUNS)


def _cut(borders: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted blocks, as border runs; a run has one gram place in its text."""
    lists = blocks.withColumn("at", _start() + F.col("place").bitwiseAND(255)).groupBy("node", "at").agg(F.collect_list("place").alias("places"))  # at most one run's
    joined = borders.withColumn("at", F.col("lo") + F.col("off")).join(lists, ["node", "at"])
    part = joined.select("gram", "node", "lo", "data", F.explode("places").alias("place"))
    count = F.shiftright("place", 8).bitwiseAND(255)
    cut = F.substring(F.col("data"), (_start() - F.col("lo") + 1).cast("int"), (count - 1 + length).cast("int"))
    return part.select("gram", F.col("place").bitwiseAND(255).cast("int").alias("off"), "node", _start().alias("lo"), cut.alias("data"))


def _start() -> Column:
    return F.shiftright("place", 16)


def _spans(runs: DataFrame, length: int) -> DataFrame:
    return runs.select("node", _start().alias("lo"), (_start() + F.shiftright("place", 8).bitwiseAND(255) - 1 + length).alias("hi"))


def _repeated(runs: DataFrame) -> DataFrame:
    """The runs whose gram occurs more than once."""
    shared = runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    return runs.join(shared, "gram", "left_semi")


def _pass(runs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of runs that are repeated as a whole, and one of each distinct run (gram, node, place) of grams that have several."""
    hits = materialise(_repeated(runs), "hits")
    by_run = hits.groupBy("gram", "run").agg(F.count("*").alias("n"), F.min(F.struct("node", "place")).alias("first"))
    by_run = materialise(by_run, "runs")
    whole = hits.join(by_run.where("n > 1").select("gram", "run"), ["gram", "run"], "left_semi")
    mixed = by_run.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    return _spans(whole, length), by_run.join(mixed, "gram", "left_semi").select("gram", "first.node", "first.place")


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``node, lo, hi`` of byte ranges that repeated strings cover (they may overlap)."""
    runs, wanted = _pass(_runs(texts, length), length)
    borders = materialise(_borders(texts, wanted, length), "borders")
    blocks, wanted = _pass(_blocks(borders, length, BLOCK), length)
    strings = _blocks(_cut(borders, wanted, length), length, 1)
    return runs.union(blocks).union(_spans(_repeated(strings), length))


def covered(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, min(b, n)) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_bytes, n_removed, n_spans, kept_sha256`` and the kept bytes' ``spans`` removed."""
    texts = id_and_text(docs, id_col, text_col).withColumn("node", F.coalesce("doc_id", F.xxhash64("text"))).select("doc_id", "node", "text")
    marks = repeated_spans(texts.select("node", "text"), length)
    marks = materialise(marks.groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")), "marks")  # at most one text's strings
    ids = marks.select("node")
    if ids.count() <= MAX_IDS:  # texts without marks need no shuffle
        rest = texts.join(F.broadcast(ids), "node", "left_anti").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
        joined = only(texts, ids).join(marks, "node").unionByName(rest)
    else:
        joined = texts.join(marks, "node", "left")
    joined = joined.select("doc_id", "text", F.col("marks.lo").alias("lo"), F.col("marks.hi").alias("hi"))

    def batch(cols):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, lo, hi in zip(cols["text"], cols["lo"], cols["hi"], strict=True):
            spans = covered(list(zip(lo or [], hi or [], strict=True)), len(text))
            kept, last = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(text[last:a])
                last = b
            kept.update(text[last:])
            values = (len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest())
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        return {"doc_id": cols["doc_id"]} | out

    return map_batches(joined, batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", binary=("text",))
