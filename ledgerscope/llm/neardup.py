"""Near-duplicate vectors by product quantisation.

Two vectors of one label and one length link when their cosine is at least
``threshold``; for unit vectors that is a distance of at most ``radius`` =
sqrt(2 - 2 * threshold).

Index.  A bounded sample (``SAMPLE_ROWS``) fits coarse centroids, one inverted
list each, and one code book per subspace of the residuals.  Every vector is
assigned to its nearest centroid and coded; its code error (the distance to
what the code decodes to) is kept beside the code.

Probes.  A vector within the radius of one in another list lies at most that
far from the plane between both centroids, so it probes the lists whose plane
is nearer than ``slack``.  ``slack`` is the radius in up to ``SIGMAS`` ** 2
dimensions, which misses nothing; in more, it is ``SIGMAS`` / sqrt(dims) of it,
since an offset in no special direction has a component of 1 / sqrt(dims) of
its length along a given one.  Probing only lists of lower number finds each
pair once.

Distances.  A list's codes are compared by table look-ups: for each probing
vector and subspace the distances to all code words, one look-up per code.
A pair is dropped only if this distance exceeds the radius by more than the
code error, so no link is lost here.  The rest is ranked by the exact cosine in
double precision on the vectors as given.

Work units.  Equal vectors of a label are one class with a count before
anything is compared.  A list of more than ``BLOCK`` rows is cut into blocks,
and pairs of blocks are units, so no task holds a list whole.  A unit gives link counts
and a spanning forest of its links, never its pairs.

Defined cases: a vector that is null, empty, zero or has null, NaN or infinite
components, or whose label is null, links with nothing.  Vectors of unlike length
link with nothing.  Repeated rows, and rows that repeat an id, are vectors of
their own; a row without an id links like others, and a component's id is its
least id (null if there is none).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructType

from ledgerscope.llm.common import hash_sample
from ledgerscope.llm.components import components
from ledgerscope.llm.hashing import materialise

SAMPLE_ROWS = 16_384  # rows that the index is fitted on
SAMPLE_VALUES = 1 << 22  # and components in all of them together
MAX_LISTS = 1024
LIST_ROWS = 500  # rows a list has on average, until MAX_LISTS
SUBSPACE = 4  # dimensions of a subspace
CODE_WORDS = 256
SIGMAS = 4.0
BLOCK = 4096
EPS = 1e-6


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row."""
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(x[a : a + 2048] @ centres.T - half, axis=1) for a in range(0, len(x), 2048)] or [np.zeros(0, np.int64)])


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        used = own[order][at]
        centres[used] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
    return centres


def scaled(vectors: list[np.ndarray]) -> list[np.ndarray]:
    """Each vector over the power of two next to its largest component: same cosines, no overflow."""
    return [np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in vectors]


def padded(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    if vectors and all(len(v) == len(vectors[0]) for v in vectors):
        out[:, : len(vectors[0])] = vectors
    else:
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


@dataclass(frozen=True)
class Index:
    """Coarse centroids and the code books of the residuals' subspaces."""

    centres: np.ndarray  # lists x dims
    books: np.ndarray  # subspaces x code words x SUBSPACE

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 11) -> "Index":
        """From unit vectors (at least one), whose dimensions are a multiple of ``SUBSPACE``."""
        rng = np.random.default_rng(seed)
        centres = _k_means(sample, max(1, min(lists, len(sample) // 16)), 8, rng)
        rest = sample - centres[_nearest(sample, centres)]
        words = max(1, min(CODE_WORDS, len(sample) // 4))
        return cls(centres, np.stack([_k_means(part, words, 5, rng) for part in cls.parts(rest)]))

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        """subspaces x rows x SUBSPACE"""
        return np.ascontiguousarray(x.reshape(len(x), -1, SUBSPACE).transpose(1, 0, 2))

    def assign(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's list, and the lists of lower number that it probes."""
        c = self.centres
        norms = (c**2).sum(1)
        apart = np.sqrt(np.maximum(norms[:, None] + norms - 2 * c @ c.T, 0))
        own, probes = np.empty(len(x), np.int32), []
        for a in range(0, len(x), 1024):
            d = norms - 2 * x[a : a + 1024] @ c.T
            near = d.argmin(1)
            own[a : a + 1024] = near
            reach = d - d.min(1)[:, None] <= 2 * slack * apart[near] + EPS
            reach &= np.arange(len(c)) < near[:, None]
            probes.extend(np.flatnonzero(r).astype(np.int32) for r in reach)
        return own, probes

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x subspaces) of the residuals, and code errors."""
        rest = self.parts(x - self.centres[lists])
        codes = np.stack([_nearest(r, b) for r, b in zip(rest, self.books, strict=True)], axis=1)
        error = sum(((r - b[codes[:, m]]) ** 2).sum(1) for m, (r, b) in enumerate(zip(rest, self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(error)

    def tables(self, x: np.ndarray, of: int) -> np.ndarray:
        """subspaces x rows x code words: squared distances of the rows, as seen from one list, to the code words."""
        rest = self.parts(x - self.centres[of])
        return (rest**2).sum(2)[:, :, None] + (self.books**2).sum(2)[:, None, :] - 2 * rest @ self.books.transpose(0, 2, 1)


# --------------------------------------------------------------------------
# inside one work unit


def _merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` after linking the rows ``a`` with the rows ``b`` (least label of each group)."""
    while True:
        x, y = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        open_ = x < y
        if not open_.any():
            return labels
        to = np.arange(len(labels))
        np.minimum.at(to, y[open_], x[open_])  # each label's least partner; chains lead down
        while (to[to] != to).any():
            to = to[to]
        labels = to[labels]


def compare(index: Index, of: int, vectors: list[np.ndarray], codes: np.ndarray, errors: np.ndarray, role: np.ndarray, counts: np.ndarray, threshold: float):
    """Links of one unit: (weighted link counts per row, least row reached inside the unit).

    Roles: 0 row of the list's block, 1 row that is only compared with these,
    2 row of a block that is compared with itself.
    """
    radius = np.sqrt(2 - 2 * threshold)
    dims = index.centres.shape[1]
    raw = padded(scaled(vectors), dims)
    norm = np.sqrt((raw**2).sum(1))
    sizes = np.array([len(v) for v in vectors])
    listed = np.flatnonzero(role != 1)
    asking = np.flatnonzero(role != 0)
    links, labels = np.zeros(len(raw), np.int64), np.arange(len(raw))
    limit = (radius + errors[listed] + EPS) ** 2 + EPS
    block = codes[listed]
    step = max(1, min(256, (1 << 22) // max(1, len(listed))))
    for at in range(0, len(asking), step):
        q = asking[at : at + step]
        tables = index.tables(raw[q] / norm[q, None], of)
        distance = np.zeros((len(q), len(listed)))
        for m in range(len(tables)):
            distance += tables[m][:, block[:, m]]
        close = distance <= limit
        close &= (role[q] == 1)[:, None] | (q[:, None] < listed)  # a block with itself: each pair once
        a, b = np.nonzero(close)
        for s in range(0, len(a), 1 << 15):
            x, y = q[a[s : s + (1 << 15)]], listed[b[s : s + (1 << 15)]]
            cosine = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y])
            good = (cosine >= threshold) & (sizes[x] == sizes[y])
            x, y = x[good], y[good]
            np.add.at(links, x, counts[y])
            np.add.at(links, y, counts[x])
            labels = _merged(labels, x, y)
    return links, labels


# --------------------------------------------------------------------------
# Spark jobs


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows ``vec_id, h1, h2`` (hashes null where a row links with nothing) and the classes of equal vectors."""
    wide = not isinstance(vectors.schema[vector_col].dataType, ArrayType) or vectors.schema[vector_col].dataType.elementType != FloatType()
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{'double' if wide else 'float'}>").alias("vec")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    hashes = [F.when(F.col("usable"), F.xxhash64(F.lit(k), "label", "vec")).alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("*", *hashes)
    grouped = rows.where("usable").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    return rows.select("vec_id", "h1", "h2"), materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def _vectors(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b].astype(np.float64) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fit(reps: DataFrame) -> tuple[Index, int] | None:
    """The index for classes (None without any), from a bounded sample, and the number of dimensions it pads to."""
    n, longest = reps.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return None
    dims = -(-longest // SUBSPACE) * SUBSPACE
    rows = hash_sample(reps, "h1", max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dims)), salt=11).select("h1", "vec").toArrow()
    if not rows.num_rows:  # the hash chose none of a few rows
        rows = reps.select("h1", "vec").orderBy("h1").limit(1).toArrow()
    rows = rows.sort_by("h1").combine_chunks()
    column = rows.column("vec")
    sample = unit(padded(scaled(_vectors(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)), dims))
    return Index.fit(sample, min(MAX_LISTS, n // LIST_ROWS)), dims


def indexed(reps: DataFrame, index, dims: int, threshold: float, sigmas: float) -> DataFrame:
    """Every class with its list, code, code error and the lists it probes."""
    radius = float(np.sqrt(2 - 2 * threshold))
    slack = radius * min(1.0, sigmas / np.sqrt(dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                piece = b.slice(at, 4096)
                x = unit(padded(scaled(_vectors(piece.column("vec"))), dims))
                lists, probes = index.value.assign(x, slack)
                codes, errors = index.value.encode(x, lists)
                more = [pa.array(lists), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(probes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*piece.columns, *more], names=[*piece.schema.names, "list", "code", "error", "probes"])

    rows = reps.select("node", "n", "label", "vec")
    schema = StructType(list(rows.schema.fields)).add("list", IntegerType()).add("code", BinaryType()).add("error", DoubleType()).add("probes", ArrayType(IntegerType()))
    return materialise(rows.mapInArrow(run, schema), "codes")


UNIT = ["label", "list", "i", "j"]


def units(coded: DataFrame, block: int) -> DataFrame:
    """Rows with role and unit: pairs (i, j) of blocks of one list; i < 0: further slices of probing rows.

    Diagonal units also take the list's first slice of probing rows.
    """
    asked = coded.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(F.count("*").alias("asking"))
    cells = coded.groupBy("label", "list").agg(F.count("*").alias("own")).join(asked, ["label", "list"], "left")
    cells = cells.where("own > 1 OR asking > 0").select("label", "list", F.ceil(F.col("own") / block).alias("blocks"), F.ceil(F.coalesce("asking", F.lit(0)) / block).alias("slices"))
    cells = materialise(cells, "cells")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    values = ["node", "n", "vec", "code", "error"]

    def unit_of(i, j, role):
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(role).alias("role"))

    none = F.array().cast("array<struct<i:bigint,j:bigint,role:int>>")
    k = F.col("k")
    pairs = F.concat(
        F.array(unit_of(k, k, 2)),
        F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: unit_of(F.col("k"), j, 1))).otherwise(none),
        F.when(k + 1 < F.col("blocks"), F.transform(F.sequence(k + 1, F.col("blocks") - 1), lambda i: unit_of(i, F.col("k"), 0))).otherwise(none),
        F.when(F.col("slices") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.col("slices") - 1), lambda f: unit_of(-f, F.col("k"), 0))).otherwise(none),
    )
    listed = coded.join(cells, ["label", "list"]).withColumn("k", at("blocks")).select("label", "list", *values, F.inline(pairs))
    f = F.col("f")
    seats = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: unit_of(F.when(f == 0, j).otherwise(-f), j, 1))
    probing = coded.select("label", F.explode("probes").alias("list"), *values).join(cells, ["label", "list"]).withColumn("f", at("slices"))
    return listed.union(probing.select("label", "list", *values, F.inline(seats)))


def links(coded: DataFrame, index, threshold: float, block: int = BLOCK) -> DataFrame:
    """``node, found, root``: rows linked inside each unit, with weighted counts and a least row they hang together with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        vectors = [np.asarray(v, np.float64) for v in rows["vec"]]
        nodes = rows["node"].to_numpy()
        found, least = compare(index.value, int(rows["list"].iloc[0]), vectors, codes, rows["error"].to_numpy(), rows["role"].to_numpy(), rows["n"].to_numpy(), threshold)
        hit = found > 0
        return pd.DataFrame({"node": nodes[hit], "found": found[hit], "root": nodes[least[hit]]})

    return materialise(units(coded, block).groupBy(*UNIT).applyInPandas(run, "node long, found long, root long"), "links")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, sigmas: float = SIGMAS, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows, reps = classes(vectors, id_col, vector_col, label_col)
    fitted = fit(reps)
    alone = rows.where("h1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if fitted is None:
        return alone
    index = vectors.sparkSession.sparkContext.broadcast(fitted[0])
    found = links(indexed(reps, index, fitted[1], threshold, sigmas), index, threshold, block)
    counts = found.groupBy("node").agg(F.sum("found").alias("found"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = reps.select("node", "least").join(groups, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select("node", "component_id")
    result = reps.select("node", "h1", "h2", "n", "least").join(counts, "node", "left").join(named, "node", "left")
    n_links = (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links")
    result = result.select("h1", "h2", n_links, F.coalesce("component_id", "least").alias("component_id"))
    out = rows.where("h1 IS NOT NULL").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.union(alone)
