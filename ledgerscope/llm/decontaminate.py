"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, exact overlap.

The index holds the benchmark's items: a posting list per word, cut into
blocks of item ids with the highest impact of each block.  Every passage of
every training document (``passage`` words, overlapping by half; the whole
text is covered) is a query.  An item is retrieved when the passage's BM25
score reaches ``min_score`` of the score that the item's own words would get,
divided by the number of passages its length spans, so that a copy cut by
passage borders is still found.  ``BlockMaxWand`` leaves out blocks whose
bounds cannot reach the threshold; passages whose rare words together cannot
reach any item are left out before it, for whole batches at once
(``candidate_passages``).  Neither changes what is retrieved.

Each retrieved item is then verified on the words of the document's text around
the passage, by shares of five-word shingles (a part shorter than a shingle is
compared as a whole).  The question part is the item's sentences before the last
one, the answer part the last one.  An item matches (``Item.overlaps``) when

* each part reaches ``min_overlap``; where one of at least a shingle does, a part
  of at most ``SHORT`` words may do so by words in order instead, as one changed
  word would clear most of its shingles;
* or the whole item reaches ``min_overlap``, or, with at most 2 * ``SHORT`` words,
  ``ALIGNED`` by words in order;
* or the question alone reaches it and has more than ``SHORT`` words.  Such
  matches show by an ``answer_overlap`` below ``min_overlap``.  A passage needs
  only ``min_score`` of the question's score then.

The index is broadcast if the benchmark has at most ``max_items`` items; a
larger one is cut into shards of that many, one pass each, so memory stays
bounded whatever the benchmark's size.

Defined cases: null or empty texts match nothing and items without a word
are never matched; repeated rows are scanned row by row.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import id_and_text, map_batches, map_texts, worker_state

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"  # ASCII part of what ``_EDGE`` takes away
SHINGLE = 5
SHORT = 12  # words
ALIGNED = 0.8
BLOCK = 16
K1, B = 1.2, 0.75
OTHER, EMPTY = -1, -2  # for ids of words that no item has, or without a normal form


def normal(word: str) -> str:
    """Lower case without punctuation at the ends (may be empty)."""
    w = word.lower()
    if w.isalnum():
        return w
    w = w.strip(_PUNCTUATION)
    return w if w.isalnum() else _EDGE.sub("", w)


def words_in(raw: list[str]) -> list[str]:
    return [w for w in map(normal, raw) if w]


def words_of(text: str) -> list[str]:
    return words_in(text.split())


def parts_of(text: str) -> list[list[str]]:
    """Question and answer: all sentences but the last, and the last; one part if there is one sentence."""
    sentences = [s for s in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text.strip())) if s]
    if len(sentences) < 2:
        return sentences
    return [[w for s in sentences[:-1] for w in s], sentences[-1]]


def shingle_set(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def aligned(part: list[str], words: list[str]) -> float:
    """Greatest share of the part's words that stand in order in the text, at most one place off."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(part):
        places[w].append(j)
    near: dict[int, set[int]] = defaultdict(set)  # by where the part would start
    for i, w in enumerate(words):
        for j in places.get(w, ()):
            for d in (i - j - 1, i - j, i - j + 1):
                near[d].add(j)
    return max(map(len, near.values()), default=0) / len(part)


class Item:
    """Words and shingles of an item's parts and of the whole."""

    def __init__(self, text: str):
        self.words = parts_of(text)
        self.all = [w for p in self.words for w in p]
        self.shingles = [shingle_set(p) for p in self.words]
        self.whole = shingle_set(self.all)
        self.sizes = {min(SHINGLE, len(p)) for p in [*self.words, self.all] if p}
        self.asks = len(self.words) == 2 and len(self.words[0]) > SHORT  # the question is enough

    def overlaps(self, texts: list[list[str]], least: float) -> list[float] | None:
        """The parts' overlaps with the texts if the item matches."""
        if not self.all:
            return None
        seen = {tuple(t[i : i + s]) for t in texts for s in self.sizes for i in range(len(t) - s + 1)}
        shares = [len(p & seen) / len(p) for p in self.shingles]
        if min(shares) >= least:
            return shares
        if any(x >= least and len(p) >= SHINGLE for x, p in zip(shares, self.words, strict=True)):
            shares = [x if x >= least or len(p) > SHORT else max(x, *(aligned(p, t) for t in texts)) for x, p in zip(shares, self.words, strict=True)]
        if min(shares) >= least or len(self.whole & seen) >= least * len(self.whole) or (self.asks and shares[0] >= least):
            return shares
        if SHINGLE <= len(self.all) <= 2 * SHORT and max(aligned(self.all, t) for t in texts) >= ALIGNED:
            return [max(aligned(p, t) for t in texts) for p in self.words]
        return None


@dataclass(frozen=True)
class Block:
    first: int  # first and last item in it
    last: int
    bound: float  # highest impact
    items: tuple[int, ...]
    impacts: tuple[float, ...]


class Bm25Index:
    """Posting lists of the items' words in blocks, with each block's highest impact."""

    def __init__(self, items: list[tuple[int, str]], min_score: float, passage: int):
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.items = [Item(t) for _, t in items]
        n, mean = len(items), sum(map(len, words)) / max(1, len(items))
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        df = Counter(w for ws in words for w in set(ws))
        self.thresholds = []
        weights: list[dict[str, float]] = [{} for _ in items]
        for k, ws in enumerate(words):
            own = asked = 0.0
            question = set(self.items[k].words[0]) if self.items[k].asks else set()
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / max(mean, 1)))
                postings[w].append((k, impact))
                weights[k][w] = impact
                own += impact
                asked += impact if w in question else 0.0
            # A passage sees at least this share of a copy, wherever the copy lies.
            share = own / max(1, math.ceil(2 * len(ws) / passage))
            if question:
                share = min(share, asked / max(1, math.ceil(2 * len(self.items[k].words[0]) / passage)))
            self.thresholds.append(min_score * share if ws else math.inf)
        self.longest = max(map(len, words), default=0)
        self.lists = {
            w: [Block(p[0][0], p[-1][0], max(x for _, x in p), *map(tuple, zip(*p, strict=True))) for p in (ps[i : i + BLOCK] for i in range(0, len(ps), BLOCK))]
            for w, ps in postings.items()
        }
        self.bounds = {w: max(b.bound for b in bs) for w, bs in self.lists.items()}
        self.least = min(self.thresholds, default=math.inf)
        self._essential(postings, n)
        self.weights = [{self.word_id[w]: x for w, x in own.items()} for own in weights]

    def reaches(self, item: int, query: set[int]) -> bool:
        """Whether the words with these ids can reach the item's threshold (up to rounding)."""
        weights = self.weights[item]
        return sum(weights[w] for w in weights.keys() & query) >= self.thresholds[item] * (1 - 1e-9)

    def _essential(self, postings: dict[str, list[tuple[int, float]]], n: int) -> None:
        """Postings of the essential words as arrays, and what an item needs from them.

        Frequent words add little; an item's whole sum over them is taken as
        given, so a passage can reach the item only if its essential words
        make up for the rest (``needed``).  Items for which that rest is small
        have all their words essential.
        """
        common = {w for w, ps in postings.items() if len(ps) > max(1, 0.05 * n)}
        rest = np.zeros(n)
        for w in common:
            for k, x in postings[w]:
                rest[k] += x
        thresholds = np.array(self.thresholds)
        tight = {k for k in range(n) if thresholds[k] - rest[k] < 0.5 * thresholds[k]}
        kept = {w: [(k, x) for k, x in ps if w not in common or k in tight] for w, ps in postings.items()}
        kept = {w: ps for w, ps in kept.items() if ps}
        self.needed = thresholds - np.where(np.isin(np.arange(n), list(tight)), 0.0, rest)
        self.names = [*kept, *(w for w in postings if w not in kept)]
        self.word_id = {w: i for i, w in enumerate(self.names)}  # essential words first
        sizes = [len(ps) for ps in kept.values()]
        self.offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.post_items = np.array([k for ps in kept.values() for k, _ in ps], np.int64)
        self.post_impacts = np.array([x for ps in kept.values() for _, x in ps])


class BlockMaxWand:
    """All items whose score for a query reaches their threshold."""

    def __init__(self, index: Bm25Index):
        self.index = index

    def search(self, query: set[str], within: list[int] | None = None) -> list[int]:
        """Items in order; ``within`` lists the items in reach, in order, where that is known."""
        index = self.index
        least = index.least if within is None else min((index.thresholds[i] for i in within), default=math.inf)
        # Cursors: [item, bound of the list, blocks, block, place in the block]
        cursors = [[bs[0].first, index.bounds[w], bs, 0, 0] for w in query if (bs := index.lists.get(w))]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[1]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            if within is not None:
                k = bisect_left(within, item)
                if k == len(within):
                    break
                if within[k] > item:  # nothing before the next item in reach counts
                    for c in cursors:
                        if c[0] < within[k]:
                            self._advance(c, within[k])
                    cursors = [c for c in cursors if c[0] < math.inf]
                    continue
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Block bounds at the pivot item.
            near = 0.0
            upto = math.inf
            for c in cursors[: pivot + 1]:
                b = self._block_at(c, item)
                if b is not None:
                    near += b.bound
                    upto = min(upto, b.last)
            if near < least:
                after = upto + 1 if upto < math.inf else item + 1
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                target = max(after, item + 1)
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._advance(c, item)
                    if c[0] == item:
                        score += c[2][c[3]].impacts[c[4]]
                if score >= index.thresholds[item]:
                    found.append(item)
                target = item + 1
            for c in cursors[: pivot + 1]:
                self._advance(c, target)
            cursors = [c for c in cursors if c[0] < math.inf]
        return found

    @staticmethod
    def _block_at(c: list, item: int) -> Block | None:
        k, blocks = c[3], c[2]
        while k < len(blocks) and blocks[k].last < item:
            k += 1
        return blocks[k] if k < len(blocks) else None

    @staticmethod
    def _advance(c: list, item: int) -> None:
        """Move a cursor to its first item that is at least ``item``."""
        blocks = c[2]
        while c[3] < len(blocks) and blocks[c[3]].last < item:
            c[3], c[4] = c[3] + 1, 0
        if c[3] == len(blocks):
            c[0] = math.inf
            return
        items = blocks[c[3]].items
        while items[c[4]] < item:
            c[4] += 1
        c[0] = items[c[4]]


class Scanner:
    """Scans texts against one index; remembers the index's word of each raw word (bounded)."""

    def __init__(self, index: Bm25Index, passage: int, min_overlap: float, cache_size: int = 100_000):
        self.index, self.passage, self.min_overlap, self.cache_size = index, passage, min_overlap, cache_size
        self.wand = BlockMaxWand(index)
        self.raw: dict[str, int] = {}

    def _word_ids(self, lowered: list[str]) -> list[int]:
        """Id of each lower-cased word's normal form: ``OTHER`` if it is not in the index, ``EMPTY`` if nothing is left."""
        ids, known = self.index.word_id, self.raw
        values = list(map(ids.get, lowered))  # normal forms stand in the index as they are
        for k in [k for k, v in enumerate(values) if v is None]:
            w = lowered[k]
            if w.isalnum():  # its own normal form
                values[k] = OTHER
                continue
            v = known.get(w)
            if v is None:
                form = normal(w)
                v = ids.get(form, OTHER) if form else EMPTY
                if len(w) <= 64:
                    if len(known) >= self.cache_size:
                        known.clear()
                    known[w] = v
            values[k] = v
        return values

    def candidate_passages(self, texts: list[list[int]]) -> list[tuple[int, int, list[int], set[int]]]:
        """(text, first word, items in reach, ids of its words) of the passages whose words can reach some item; texts as word ids."""
        index, half = self.index, self.passage // 2
        words = np.fromiter(chain.from_iterable(texts), np.int64)
        if not len(words) or not len(index.post_items):
            return []
        n = np.array([len(t) for t in texts])
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        count = np.maximum(1, -(-(n - half) // half))  # passages of each text
        base = np.concatenate(([0], np.cumsum(count)))[:-1]
        essential = len(index.offsets) - 1
        at = np.flatnonzero((words >= 0) & (words < essential))
        text = np.searchsorted(first, at, side="right") - 1
        place = (at - first[text]) // half
        # A word lies in the passage that starts in its half, and in the one before; it counts once in each.
        keys = (base[text] + place) * essential + words[at]
        passage, ids = np.divmod(np.unique(np.concatenate([keys[place < count[text]], keys[place > 0] - essential])), essential)
        size = index.offsets[ids + 1] - index.offsets[ids]
        entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - index.offsets[ids], size)
        found, back = np.unique(np.repeat(passage, size) * len(index.ids) + index.post_items[entry], return_inverse=True)
        sums = np.bincount(back, weights=index.post_impacts[entry], minlength=len(found))
        found = found[sums >= index.needed[found % len(index.ids)] * (1 - 1e-9)]
        within: dict[int, list[int]] = defaultdict(list)
        for p, item in zip((found // len(index.ids)).tolist(), (found % len(index.ids)).tolist(), strict=True):
            within[p].append(item)
        out = []
        for t, (p, items) in zip((np.searchsorted(base, list(within), side="right") - 1).tolist(), within.items(), strict=True):
            a = int(p - base[t]) * half
            query = set(texts[t][a : a + self.passage]) - {OTHER, EMPTY}
            items = [i for i in items if index.reaches(i, query)]
            if items:
                out.append((t, a, items, query))
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, float, float, int]]]:
        """For each text, (item id, question overlap, answer overlap, first word) of each verified item."""
        index, split = self.index, [self._word_ids(t.lower().split()) for t in texts]
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, a, within, query in self.candidate_passages(split):
            for item in self.wand.search({index.names[i] for i in query}, within):
                found[t][item].append(a)
        out: list[list[tuple[int, float, float, int]]] = [[] for _ in texts]
        for t, items in found.items():
            for item, at in sorted(items.items()):
                # Question and answer may lie in different passages: the text around all of the item's passages counts.
                reach = index.longest
                near = [self._words(split[t][max(0, a - reach) : a + self.passage + reach]) for a in at]
                shares = index.items[item].overlaps(near, self.min_overlap)
                if shares:
                    out[t].append((index.ids[item], shares[0], shares[-1], at[0]))
        return out

    def _words(self, ids: list[int]) -> list[str]:
        """The normal forms, without empty ones; a word that no item has is an empty string, which no item has either."""
        names = self.index.names
        return [names[i] if i >= 0 else "" for i in ids if i != EMPTY]


def _scanner(key: str, index: Bm25Index, passage: int, min_overlap: float) -> Scanner:
    return worker_state(key, lambda: Scanner(index, passage, min_overlap))


MATCHES = "doc_id long, item_id long, question_overlap double, answer_overlap double, first_word long"


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, min_score: float, passage: int, max_items: int) -> list[tuple]:
    """(broadcast index, key) of each shard of at most about ``max_items`` items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    shards = max(1, -(-items.count() // max_items))
    out = []
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard) if shards > 1 else items
        index = Bm25Index(sorted((r["id"], r["text"]) for r in rows.collect()), min_score, passage)
        out.append((benchmark.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex))
    return out


def _scan(texts: list[str], shared, key: str, passage: int, min_overlap: float) -> list[list[tuple[int, float, float, int]]]:
    scanner = _scanner(key, shared.value, passage, min_overlap)
    return [found for at in range(0, len(texts), 128) for found in scanner.scan(texts[at : at + 128])]


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    passage: int = 128, min_score: float = 0.5, min_overlap: float = 0.6, max_items: int = 20_000,
) -> DataFrame:
    """Verified matches: ``doc_id, item_id``, overlaps and the word where the first passage starts."""
    texts = id_and_text(docs, id_col, text_col)
    results = []
    for shared, key in _indexes(benchmark, item_col, item_text_col, min_score, passage, max_items):

        def batch(cols, shared=shared, key=key):
            matches = _scan(cols["text"], shared, key, passage, min_overlap)
            found = [(d, *m) for d, ms in zip(cols["doc_id"], matches, strict=True) for m in ms]
            names = ("doc_id", "item_id", "question_overlap", "answer_overlap", "first_word")
            return dict(zip(names, map(list, zip(*found, strict=True)), strict=True)) if found else None

        results.append(map_batches(texts, batch, MATCHES))
    return reduce(DataFrame.unionByName, results)


def keep(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    passage: int = 128, min_score: float = 0.5, min_overlap: float = 0.6, max_items: int = 20_000,
) -> DataFrame:
    """The documents without a verified match, all columns unchanged."""
    for shared, key in _indexes(benchmark, item_col, item_text_col, min_score, passage, max_items):

        def clean(texts, shared=shared, key=key):
            return [None if ms else t for t, ms in zip(texts, _scan(texts, shared, key, passage, min_overlap), strict=True)]

        docs = map_texts(docs, text_col, clean)
    return docs
