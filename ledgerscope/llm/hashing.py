"""Vectorised hashes of words and byte windows, and tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))  # a fixed table: the same on every worker
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=U, endpoint=False)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits of 64-bit values (the constants are the usual ones of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` + 1 of them."""
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U)
    return _POWERS["up"], _POWERS["down"]


class Spans:
    """Hashes of any byte spans of one buffer, from prefix sums (modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data))
        self._sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self._sums[1:], dtype=U)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span; equal contents have equal hashes."""
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] ^ (ends - starts).astype(U))

    def fixed(self, length: int) -> np.ndarray:
        """Hash of the ``length`` bytes at each place."""
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, U)


def slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together (a longer text alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


LONG_WORD = 256  # bytes


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hash of each word of each text, A-Z lower-cased."""
    if not texts:
        return []
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    space = _IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    starts, ends = edges[::2], edges[1::2]  # the buffer ends with a space, so edges pair up
    hashes = Spans(data).of(starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD):  # a sum modulo 2**64 is no hash of long regular words
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    borders = np.cumsum([len(t) + 1 for t in texts])[:-1]
    return np.split(hashes, np.searchsorted(starts, borders))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes, in order, of a text's shingles; a shorter text is one shingle, none without words."""
    if not len(words):
        return np.zeros(0, U)
    k = min(size, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, U)
    for j in range(k):
        total = mix(total * U(_BASE) + words[j : j + n])
    return np.unique(total)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, a
    cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back (cuts the lineage)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
