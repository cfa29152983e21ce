"""Quality rules: fixed counting rules, then distribution divergence.

A document's character-class histogram and its common-word histogram are
compared with references of the corpus's languages by Jensen-Shannon
distance.  A document passes when some language is near in both; a histogram
is only compared when the document is long enough for it (``min_chars``,
``min_words``), so short documents are never judged on noise.

References are counted over all documents with a language (``fit``): every
language of at least ``min_count`` words has one, whatever its share, so that a
common word (``word_share`` of its language's words) rests on ten occurrences
or more.  They are small by construction: at most 1 / word_share words a
language and ``MAX_LANGS`` languages.  A document whose own language has no
reference passes the divergence test, as does every document without
references; one without a language is compared with all.

Defined cases: null or empty text has no words and fails the base rule;
one-word and very long texts follow the same rules.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import SPACE, id_and_text, map_batches, map_texts, tidy
from ledgerscope.llm.hashing import materialise

WS = SPACE.encode()
SYMBOLS = b"#*$%&|<>"
_NOT_WORD_CHARS = WS + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes

#: Character classes by byte; every lead byte of a non-ASCII character is one class.
_CLASSES = [
    re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"), re.compile(rb"[ \t\x0b\x0c\r]"), re.compile(rb"\n"),
    re.compile(rb"[.,;:]"), re.compile(rb"[!?]"), re.compile(rb"['\"()\-]"), re.compile(rb"[#*$%&|<>]"), re.compile(rb"[\xc0-\xff]"),
]
N_CLASSES = len(_CLASSES) + 1
CLASS_OF = np.full(256, N_CLASSES - 1)
for _i, _rx in enumerate(_CLASSES):
    for _b in range(256):
        if _rx.match(bytes([_b])):
            CLASS_OF[_b] = _i
CLASS_OF[0x80:0xC0] = N_CLASSES  # continuation bytes are not counted
MAX_LANGS = 1000  # references that are collected and broadcast
_FLUSH = 100_000  # entries of a map task's counter before it is handed on


@dataclass(frozen=True)
class References:
    """Per language: class shares, and common-word shares over a joint vocabulary (last: all other words)."""

    langs: list[str] = field(default_factory=list)
    classes: np.ndarray = field(default_factory=lambda: np.zeros((0, N_CLASSES)))
    vocab: dict[bytes, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))


def class_histogram(text: bytes) -> np.ndarray:
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(CLASS_OF, weights=by_byte, minlength=N_CLASSES + 1)[:N_CLASSES]


def _count_batches(batches):
    import pyarrow as pa

    counts: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}
    held = 0

    def flush():
        few = [(lang, "c", str(i), int(n)) for lang, h in classes.items() for i, n in enumerate(h) if n]
        few += [(lang, "n", "", sum(c.values())) for lang, c in counts.items()]
        classes.clear()
        parts = [part(*map(list, zip(*few, strict=True)))] if few else []
        while counts:  # one language's words at a time are held twice
            lang, c = counts.popitem()
            parts.append(part([lang] * len(c), ["w"] * len(c), [w.decode("utf-8", "replace") for w in c], list(c.values())))
        return parts

    def part(*columns):
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "kind", "item", "n"])

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
            lang, text = lang.as_py(), text.as_py()
            c = counts.setdefault(lang, Counter())
            before = len(c)
            c.update(text.split())
            held += len(c) - before
            h = classes.get(lang)
            classes[lang] = class_histogram(text) if h is None else h + class_histogram(text)
            if held > _FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", word_share: float = 0.002, min_count: int = 5000) -> References:
    """References counted over all documents with a language; the result is bounded (see module)."""
    texts = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    counts = texts.mapInArrow(tidy(_count_batches), "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    # Words below the least count that any language can ask for are not kept.
    counts = materialise(counts.where((F.col("kind") != "w") | (F.col("n") >= word_share * max(1, min_count))), "word-counts")
    enough = counts.where((F.col("kind") == "n") & (F.col("n") >= max(1, min_count)))
    totals = {r["lang"]: r["n"] for r in enough.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    langs = sorted(totals)
    if not langs:
        return References()
    least = F.element_at(F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(word_share * totals[lang]))]), F.col("lang"))
    rows = counts.where(F.col("lang").isin(langs) & ((F.col("kind") == "c") | ((F.col("kind") == "w") & (F.col("n") >= least)))).collect()
    vocab = {w: i for i, w in enumerate(sorted({r["item"].encode() for r in rows if r["kind"] == "w"}))}
    classes, words = np.zeros((len(langs), N_CLASSES)), np.zeros((len(langs), len(vocab) + 1))
    place = {lang: k for k, lang in enumerate(langs)}
    for r in rows:
        k = place[r["lang"]]
        if r["kind"] == "c":
            classes[k, int(r["item"])] = r["n"]
        else:
            words[k, vocab[r["item"].encode()]] = r["n"]
    words[:, -1] = [totals[lang] - words[k].sum() for k, lang in enumerate(langs)]
    return References(langs, classes / classes.sum(1, keepdims=True).clip(1), vocab, words / words.sum(1, keepdims=True).clip(1))


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)


def js_distance(hist: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of one histogram to each reference row."""
    p = hist / max(hist.sum(), 1)
    m = (refs + p) / 2
    return np.sqrt(np.clip(_entropy(m) - (_entropy(refs) + _entropy(p)) / 2, 0, 1))


def word_distance(ids: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """``js_distance`` of the histogram of ``ids`` to reference rows that sum to 1, from the columns that occur in it."""
    at, counts = np.unique(ids, return_counts=True)
    p, q = counts / max(len(ids), 1), refs[:, at]
    rest = 1 - q.sum(1)  # a reference's share of what does not occur counts half
    return np.sqrt(np.clip(_entropy((q + p) / 2) - (_entropy(q) + _entropy(p)) / 2 + rest / 2, 0, 1))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside ``window``-word windows that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(31)
        w = np.zeros(n, np.uint64)
        for j in range(window):
            w += h[j : j + n] * _MIX[j % len(_MIX)] * np.uint64(2 * (j // len(_MIX)) + 1)
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not twice.size:
        return 0
    hit = np.isin(w, twice).astype(np.int8)
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def rules(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip(WS)]
    repeats = repeated_words(words)
    return (
        n,
        len(text.translate(None, _NOT_WORD_CHARS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        n < 20 or 100 * repeats > 30 * n,
    )


def divergence(text: bytes, words: list[bytes], refs: References) -> tuple[float, float, int]:
    """Class distance, word distance and index of the nearest language (by their sum); zeros without references."""
    if not refs.langs:
        return 0.0, 0.0, -1
    c = js_distance(class_histogram(text), refs.classes)
    w = word_distance(np.fromiter(map(refs.vocab.get, words, repeat(len(refs.vocab))), np.int64, len(words)), refs.words)
    best = int(np.argmin(c + w))
    return float(c[best]), float(w[best]), best


@dataclass(frozen=True)
class Limits:
    """Greatest distances to the nearest language, and the lengths from which they are compared."""

    max_class_js: float = 0.30
    max_word_js: float = 0.45
    min_chars: int = 200
    min_words: int = 100


def verdict(text: bytes, refs: References, limits: Limits, lang: str | None = None) -> tuple:
    """Counts of ``rules``, class distance, word distance, nearest language, kept; ``lang`` is the document's own language."""
    words = text.split()
    counts = rules(text, words)
    c, w, best = divergence(text, words, refs)
    far = (counts[1] >= limits.min_chars and c > limits.max_class_js) or (counts[0] >= limits.min_words and w > limits.max_word_js)
    judged = lang is None or lang in refs.langs
    return (*counts, c, w, refs.langs[best] if best >= 0 else None, not counts[5] and not (judged and far))


def assess(docs: DataFrame, refs: References, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), lang_col: str = "lang") -> DataFrame:
    """One row per document: counts, ``base_failed``, distances, nearest language and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_js", "word_js", "nearest_lang", "kept"]

    def batch(cols):
        rows = [verdict(text, refs, limits, lang) for text, lang in zip(cols["text"], cols["lang"], strict=True)]
        return {"doc_id": cols["doc_id"]} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else None

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_js double, word_js double, nearest_lang string, kept boolean"
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    return map_batches(id_and_text(texts, keep=("lang",)), batch, schema, binary=("text",))


def keep(docs: DataFrame, refs: References, text_col: str = "text", limits: Limits = Limits(), lang_col: str = "lang") -> DataFrame:
    """The documents that pass, all columns unchanged."""

    def passed(texts, langs=None):
        langs = [None] * len(texts) if langs is None else [None if x is None else str(x) for x in langs]
        return [t if verdict(t.encode(), refs, limits, lang)[-1] else None for t, lang in zip(texts, langs, strict=True)]

    return map_texts(docs, text_col, passed, (lang_col,) if lang_col in docs.columns else ())
