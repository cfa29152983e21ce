"""Secret scans: fixed patterns, plus character Markov models for random strings.

Two order-1 character models give the log-likelihood of a token: one trained
on random strings, one on ordinary identifiers (words and words joined into
identifiers).  A token whose log-likelihood ratio exceeds ``min_llr`` in total
and ``min_rate`` per character, and that has ``min_distinct`` characters, is
reported as kind ``markov``, unless a pattern match already covers a part of it.

``training_sample`` builds the labelled strings from a bounded hash sample of
the documents (``max_docs``): values that the patterns find and generated
random strings over the usual key alphabets are labelled 1; letter-only words
outside of matches, alone and joined to identifiers, are labelled 0.

Defined cases: null or empty text has no spans; the model is a small array
(``N_SYMBOLS`` squared), so nothing that grows with the input is broadcast.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import hash_sample, id_and_text, map_batches, map_texts, tidy

KINDS = ("assign", "access", "hex", "markov")

# Fixed patterns of the contract; only the key names match in either case.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the same as maximal runs of which the short ones are dropped
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORD = re.compile(r"[^\W\d_]+")
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N_SYMBOLS = len(_SYMBOLS) + 1  # the last stands for any other character
_CODE = {c: i for i, c in enumerate(_SYMBOLS)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that are long enough, by start, then kind."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio (random against ordinary) of each character pair."""

    ratio: np.ndarray

    def llr(self, token: str) -> float:
        codes = [_CODE.get(c, N_SYMBOLS - 1) for c in token]
        return float(sum(self.ratio[a, b] for a, b in pairwise(codes)))


def pair_counts(samples: DataFrame, text_col: str = "sample", label_col: str = "is_random") -> DataFrame:
    """``at, n``: count of each character pair of each label, as a place in the array of both labels' pairs.

    Equal strings are counted first.  That shuffle also parts the task that
    makes the strings from the one that reads them: in one task each would have
    a Python worker, and an executor keeps as many as ever ran at once.
    """

    def pairs(batches):
        for b in batches:
            counts = np.zeros((2, N_SYMBOLS, N_SYMBOLS), np.int64)
            for s, y, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                codes = [_CODE.get(c, N_SYMBOLS - 1) for c in s]
                for a, c in pairwise(codes):
                    counts[y, a, c] += n
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["at", "n"])

    clean = samples.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(text_col).cast("string").alias("s"), F.col(label_col).cast("int").alias("y"))
    strings = clean.groupBy("s", "y").agg(F.count("*").alias("n"))
    return strings.mapInArrow(tidy(pairs), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def train(samples: DataFrame, text_col: str = "sample", label_col: str = "is_random", smoothing: float = 0.5) -> MarkovModel:
    """Models from labelled strings; pair counts are summed by Spark, so the result has a fixed size."""
    counts = np.zeros(2 * N_SYMBOLS * N_SYMBOLS)
    for r in pair_counts(samples, text_col, label_col).collect():
        counts[r["at"]] = r["n"]
    counts = counts.reshape(2, N_SYMBOLS, N_SYMBOLS) + smoothing
    logs = np.log(counts / counts.sum(2, keepdims=True))
    return MarkovModel(logs[1] - logs[0])


def random_strings(n: int = 400, seed: int = 7) -> list[str]:
    """Labelled random strings, ``n`` for each key alphabet."""
    rng = random.Random(seed)
    return ["".join(rng.choices(a, k=rng.randint(20, 48))) for a in _ALPHABETS.values() for _ in range(n)]


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2000) -> DataFrame:
    """Labelled strings (``sample``, ``is_random``) from about ``max_docs`` documents and the generator."""

    def batch(cols):
        out: dict[str, list] = {"sample": [], "is_random": []}
        for text in cols["text"]:
            spans = base_spans(text)
            inside = [text[a:b].rsplit("=", 1)[-1].strip(" \"'") for a, _, b in spans]
            out["sample"] += inside
            out["is_random"] += [1] * len(inside)
            rest, last = [], 0
            for a, _, b in spans:
                rest.append(text[last:max(a, last)])
                last = max(b, last)
            words = _WORD.findall(" ".join([*rest, text[last:]]))
            named = [sep.join(words[i : i + 3]) for i, sep in zip(range(0, len(words) - 2, 3), ["_", "-", "", "/"] * (len(words) // 12 + 1), strict=False)]
            camel = ["".join(w.capitalize() for w in words[i : i + 3]) for i in range(0, len(words) - 2, 9)]
            out["sample"] += words + named + camel
            out["is_random"] += [0] * (len(words) + len(named) + len(camel))
        return out

    sample = hash_sample(id_and_text(docs, id_col, text_col), "doc_id", max_docs)
    found = map_batches(sample.select("text"), batch, "sample string, is_random int")
    strings = random_strings()
    made = docs.sparkSession.createDataFrame(pa.table({"sample": strings, "is_random": pa.array([1] * len(strings), pa.int32())}))  # rows from Arrow need no Python worker
    return found.unionByName(made)


@dataclass(frozen=True)
class Limits:
    """What a token outside the patterns needs: total ratio, ratio per character, distinct characters."""

    min_llr: float = 20.0
    min_rate: float = 0.8
    min_distinct: int = 8


def markov_spans(text: str, base: list[tuple[int, int, int]], model: MarkovModel, limits: Limits) -> list[tuple[int, int, int]]:
    """Spans of random-looking tokens that no pattern match touches."""
    spans = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if any(x < b and a < y for x, _, y in base):
            continue
        llr = model.llr(m.group())
        if llr >= limits.min_llr and llr >= limits.min_rate * (b - a) and len(set(m.group())) >= limits.min_distinct:
            spans.append((a, 3, b))
    return spans


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: counts of each kind, digest of the pattern spans, all spans."""

    def batch(cols):
        names = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
        out: dict[str, list] = {"doc_id": cols["doc_id"]} | {n: [] for n in names}
        for text in cols["text"]:
            spans = base_spans(text)
            base = joined(spans)
            more = markov_spans(text, spans, model, limits)
            count = [sum(k == i for _, k, _ in spans) for i in range(3)]
            values = [*count, len(more), hashlib.sha256(base.encode()).hexdigest(), joined(sorted(spans + more)) if more else base]
            for n, v in zip(names, values, strict=True):
                out[n].append(v)
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return map_batches(id_and_text(docs, id_col, text_col), batch, schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, last = [], 0
    for a, _, b in sorted(spans):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, model: MarkovModel, text_col: str = "text", mark: str = "[secret]", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; other columns and texts without spans are unchanged."""

    def texts_of(texts):
        out = []
        for t in texts:
            base = base_spans(t)
            out.append(redacted(t, base + markov_spans(t, base, model, limits), mark))
        return out

    return map_texts(docs, text_col, texts_of)
