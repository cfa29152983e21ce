"""Toxicity by a weighted grammar over clauses.

Words are first mapped to classes: insults (a lexicon of words and word stems
with weights learned from labelled documents), threats, targets, negation and
reported speech (small fixed lists).  Five transducers read a clause's classes
and are composed into one pass (``clause_score``): the insult and threat
transducers emit weights, the target transducer raises them when a person
is meant, the negation and reported-speech transducers lower what they govern.
A document's score is a logistic function of its matched clauses (their sum,
the highest one, and their share of all clauses), fitted on labelled rows.

``fit`` uses a bounded hash sample of the labelled rows (``max_docs``); the
lexicon holds at most ``max_items`` entries.  Labels, language, source and id
are never inputs of a score.

Defined cases: a null or empty text scores as a text without matched clauses;
without labelled rows of both kinds that score is given to every document.
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

# Fixed word lists (English, German, French, Spanish).
THREATS = "kill killed hurt destroy shoot stab burn attack töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u they them he she him her du dich dir ihr euch sie er tu toi vous te il elle tú usted ustedes vosotros él ella".split()
NEGATIONS = "not no never isn't aren't don't nobody nicht kein keine nie niemals ne pas jamais nunca jamás".split()
REPORTS = "said says say wrote called quoted told reported according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split()

NEGATION_SPAN, TARGET_SPAN = 3, 4
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.3, 0.4, 1.25, 2.0

_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_PLAIN, _THREAT, _TARGET, _NEGATION, _REPORT = range(5)
_CLASS = {w: k for k, ws in ((_THREAT, THREATS), (_TARGET, TARGETS), (_NEGATION, NEGATIONS), (_REPORT, REPORTS)) for w in ws}
_STEMS = range(3, 9)
_CACHE = 100_000


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)  # word, or stem followed by "*" -> weight
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    bias: float = -2.0

    def insult(self, word: str) -> float:
        return max((self.lexicon.get(x, 0.0) for x in items_of(word)), default=0.0)

    def score(self, features: tuple[float, ...]) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def items_of(word: str) -> list[str]:
    """The word itself and its stems."""
    return [word, *(word[:k] + "*" for k in _STEMS if len(word) > k)]


Token = tuple[float, int, bool, bool]  # insult weight, class, quoted, ends its clause


def token_of(raw: str, model: ToxicityModel) -> Token:
    words = _LETTERS.findall(raw.lower())
    kind = next((_CLASS[w] for w in words if w in _CLASS), _PLAIN)
    return max(map(model.insult, words), default=0.0), kind, raw[:1] in "\"'“«„" and bool(words), raw[-1:] in ".!?;:"


def clause_score(clause: list[Token]) -> float:
    """Composed transducers over one clause: the weight of its insults and threats in their context."""
    total, negated, reported, pending = 0.0, 0, False, 0.0
    last_target, hits = -TARGET_SPAN - 1, []
    for i, (weight, kind, quoted, _) in enumerate(clause):
        reported = reported or kind == _REPORT or quoted
        if kind == _NEGATION:
            negated = NEGATION_SPAN + 1
        if kind == _TARGET:
            last_target = i
            if pending and i - pending <= NEGATION_SPAN:  # threat verb, then its target
                weight = max(weight, THREAT_WEIGHT)
                pending = 0.0
            for k, (at, w) in enumerate(hits):
                if i - at <= TARGET_SPAN and w > 0:
                    hits[k] = (at, -w * TARGETED)  # negative marks: raised once
        if kind == _THREAT:
            pending = i + 1e-9
        if weight > 0:
            weight *= (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
            hits.append((i, -weight * TARGETED) if i - last_target <= TARGET_SPAN else (i, weight))
        negated = max(0, negated - 1)
    total += sum(abs(w) for _, w in hits)
    return total


def features_of(tokens: list[Token]) -> tuple[float, float, float]:
    """Sum (log), highest, and share of matched clauses."""
    scores, clause, n = [], [], 0
    for t in tokens:
        clause.append(t)
        if t[3]:
            scores.append(clause_score(clause))
            n, clause = n + 1, []
    if clause:
        scores.append(clause_score(clause))
        n += 1
    hit = [s for s in scores if s > 0]
    return float(np.log1p(sum(hit))), max(hit, default=0.0), len(hit) / max(n, 1)


def _tokens(key: str) -> dict[str, Token]:
    """The worker's known raw words for the model ``key``."""
    known = worker_state(key, dict)
    if len(known) > _CACHE:
        known.clear()
    return known


def document_features(text: str, model: ToxicityModel, known: dict[str, Token]) -> tuple[float, float, float]:
    raw = text.split()
    for w in set(raw).difference(known):
        known[w] = token_of(w, model)
    tokens = [known[w] for w in raw]
    if not any(t[0] or t[1] == _THREAT for t in tokens):
        return 0.0, 0.0, 0.0
    return features_of(tokens)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[tuple[float, ...], float]:
    """Newton steps of ridge logistic regression, weights kept at or above zero."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = a.T @ (a * (p * (1 - p))[:, None]) + penalty
        w = w - np.linalg.solve(hessian, a.T @ (p - y) + penalty @ w)
        w[:-1] = np.maximum(w[:-1], 0.0)
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_docs: int = 10_000, max_items: int = 5000, min_gain: float = 11.0,
) -> ToxicityModel:
    """Lexicon and weights from labelled rows where ``training`` (a condition on the id) holds."""
    spark = docs.sparkSession
    rows = labels.where(training & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null")
    rows = hash_sample(rows, "doc_id", max_docs).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(rows), "doc_id").select("text", "y")  # about max_docs small rows

    def count(batches):
        df: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df[y].update({i for w in set(_LETTERS.findall(text.lower())) for i in items_of(w)} | {""})
        items = list(df[0].keys() | df[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()), pa.array([df[1][i] for i in items], pa.int64()), pa.array([df[0][i] for i in items], pa.int64())], names=["item", "pos", "neg"]
        )

    counts = sample.mapInArrow(count, "item string, pos long, neg long").groupBy("item").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
    try:
        total = counts.where("item = ''").first()
        if total is None or not total["pos"] or not total["neg"]:
            return ToxicityModel()
        p, n = total["pos"], total["neg"]
        share, seen = F.lit(p / (p + n)), F.col("pos") + F.col("neg")
        odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
        gain = F.col("pos") * F.log(F.col("pos") / (seen * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (seen * (1 - share)))).otherwise(0.0)
        best = counts.where("item <> '' and pos > 0").select("item", odds.alias("odds"), gain.alias("gain")).where((F.col("odds") > 1.5) & (F.col("gain") >= min_gain))
        lexicon = {r["item"]: float(r["odds"]) for r in best.orderBy(F.desc("gain"), "item").limit(max_items).collect()}
    finally:
        counts.unpersist()
    grammar = spark.sparkContext.broadcast(ToxicityModel(lexicon))
    key = uuid.uuid4().hex

    def features(cols):
        m = grammar.value
        known = _tokens(key)
        return {"x": [list(document_features(t, m, known)) for t in cols["text"]], "y": cols["y"]}

    found = map_batches(sample, features, "x array<double>, y int").collect()
    weights, bias = _logistic(np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float))
    return ToxicityModel(lexicon, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def batch(cols):
        m = shared.value
        scores = [m.score(document_features(t, m, _tokens(key))) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return map_batches(texts, batch, "doc_id long, held_out boolean, score double, predicted int")
