"""Language identification by words first, then shorter and shorter character n-grams.

A word that the training rows contain is scored by its log frequency in each
language.  An unseen word is covered from left to right by the longest known
character n-gram at each place (``max_n`` down to 1 character, with a border
mark at both ends).  A document's scores are the sums over its words; the
prediction is the best language (ties: first by name), its score the softmax
share after the sums are divided by ``temperature`` words.

``fit`` counts a bounded hash sample of labelled rows (``max_docs``); the
model keeps words and n-grams seen ``min_count`` times, at most ``max_words``
and ``max_grams`` of them, so what reaches the workers is bounded.

Letters are the characters of the Unicode categories L; digits, fractions and
Roman-numeral signs are none.

Defined cases: null text, or a text without a letter, is ``und`` with score 0;
without training rows every document is ``und``.  A text with letters but no known word
or n-gram gets the first language by name.  Long texts are read whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import hash_sample, map_batches, worker_state
from ledgerscope.llm.hashing import materialise

_ALNUM = re.compile(r"[^\W\d_]+")
_CACHE = 100_000  # distinct raw words that a worker remembers


def letter_runs(text: str) -> list[str]:
    """Runs of letters (Unicode categories L)."""
    runs = _ALNUM.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)  # word -> row of word_logs
    word_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: dict[str, int] = field(default_factory=dict)
    gram_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    max_n: int = 4

    def word_scores(self, word: str) -> np.ndarray:
        """Log scores of one lower-case word per language."""
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        total, marked, i = np.zeros(len(self.langs)), f" {word} ", 0
        while i < len(marked):
            for n in range(min(self.max_n, len(marked) - i), 0, -1):
                at = self.grams.get(marked[i : i + n])
                if at is not None:
                    total = total + self.gram_logs[at]
                    break
            i += max(n, 1)
        return total


def grams_of(word: str, max_n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for n in range(1, max_n + 1) for i in range(len(marked) - n + 1)]


def _log_shares(counts: dict[tuple[str, str], int], langs: list[str], limit: int, smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    total = Counter()
    for (_, item), n in counts.items():
        total[item] += n
    items = {w: i for i, w in enumerate(sorted(w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]))}
    table = np.full((len(items), len(langs)), smoothing)
    of = {lang: k for k, lang in enumerate(langs)}
    for (lang, item), n in counts.items():
        if item in items:
            table[items[item], of[lang]] += n
    return items, np.log(table / table.sum(0, keepdims=True).clip(1e-12))


def fit(
    docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    max_docs: int = 20_000, min_count: int = 3, max_words: int = 60_000, max_grams: int = 60_000, max_n: int = 4, smoothing: float = 0.2,
) -> LanguageModel:
    """Model from the rows where ``training`` holds and the language is known (bounded, see module)."""

    def count(batches):
        words: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.update((lang, w) for w in letter_runs(text.lower()))
        grams: Counter = Counter()
        for (lang, w), n in words.items():
            for g in grams_of(w, max_n):
                grams[lang, g] += n
        for kind, c in (("w", words), ("g", grams)):
            rows = [(lang, kind, item, n) for (lang, item), n in c.items()]
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            types = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, types, strict=True)], names=["lang", "kind", "item", "n"])

    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id")
    )
    sample = hash_sample(rows, "doc_id", max_docs).select("lang", "text")
    counts = sample.mapInArrow(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    # One row per item, counted once; most frequent first: the limits bound what is collected.
    by_item = counts.groupBy("kind", "item").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("langs"))
    by_item = materialise(by_item.withColumn("known", F.col("total") >= min_count), "items")
    tables: dict[str, dict[tuple[str, str], int]] = {}
    for kind, limit in (("w", max_words), ("g", max_grams)):
        top = by_item.where((F.col("kind") == kind) & F.col("known")).orderBy(F.desc("total"), "item").limit(limit).collect()
        tables[kind] = {(x["lang"], r["item"]): x["n"] for r in top for x in r["langs"]}
    langs = sorted(r["lang"] for r in by_item.select(F.explode("langs").alias("x")).select("x.lang").distinct().collect())
    words, word_logs = _log_shares(tables["w"], langs, max_words, smoothing)
    grams, gram_logs = _log_shares(tables["g"], langs, max_grams, smoothing)
    return LanguageModel(langs, words, word_logs, grams, gram_logs, max_n)


def _remembered(key: str, n_langs: int) -> dict:
    """The worker's rows of known raw words for the model ``key``."""
    known = worker_state(key, dict)
    if not known or len(known["rows"]) > _CACHE:
        known.update(rows={}, letters=[], table=np.zeros((1 << 12, n_langs)))
    return known


def predict(
    docs: DataFrame, model: LanguageModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text", temperature: float = 10.0
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex  # workers serve one job after another

    def batch(cols):
        m: LanguageModel = shared.value
        known = _remembered(key, len(m.langs))
        rows, letters = known["rows"], known["letters"]
        flat: list[int] = []
        sizes = []
        for text in cols["text"]:
            words = text.lower().split()
            at = list(map(rows.get, words))
            if None in at:
                for w in dict.fromkeys(w for w, r in zip(words, at, strict=True) if r is None):
                    k = rows[w] = len(rows)
                    if k == len(known["table"]):
                        known["table"] = np.concatenate([known["table"], np.zeros_like(known["table"])])
                    found = letter_runs(w)
                    letters.append(len(found))
                    if m.langs and found:
                        known["table"][k] = sum(m.word_scores(x) for x in found)
                at = [rows[w] if r is None else r for w, r in zip(words, at, strict=True)]
            flat += at
            sizes.append(len(at))
        used = np.array(flat, np.int64)
        starts = np.cumsum([0, *sizes])
        preds, scores = [], []
        letter_counts = np.concatenate([[0], np.cumsum(np.array(letters, np.int64)[used])])
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            n_words = letter_counts[z] - letter_counts[a]
            if not n_words or not m.langs:
                preds.append("und")
                scores.append(0.0)
            else:
                total = known["table"].take(used[a:z], axis=0).sum(0)
                share = np.exp((total - total.max()) / max(1.0, n_words / temperature))
                best = int(total.argmax())
                preds.append(m.langs[best])
                scores.append(float(share[best] / share.sum()))
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": preds, "score": scores}

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return map_batches(texts, batch, "doc_id long, held_out boolean, lang_pred string, score double")
