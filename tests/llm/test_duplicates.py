"""N-gram Jaccard join, components and repeated-substring removal against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
from llm.helpers import documents, empty, prose
from pyspark.sql import functions as F

from ledgerscope.llm import jaccard, substrings
from ledgerscope.llm.components import components
from ledgerscope.llm.hashing import shingle_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            n = len(s & t)
            if n and 100 * n >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def edited(text, rate, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split())


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, **options).collect()}
    assert got == brute_components(rows)


def test_join_on_families_of_every_size(spark):
    rows, i = [], 0
    for family in range(40):
        base = prose(random.Random(family).choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 17, 33, 64, 150, 400]), family)
        for k in range(6):
            rows.append((i, edited(base, 0.012 * k, 100 * family + k)))
            i += 1
    check(spark, rows)


def test_large_groups_are_joined_exactly(spark):
    # One base with many copies at the border of the threshold, and a shared passage in unlike documents:
    # groups of more than ``small_group``, of which stars alone do not find every link.
    base, passage = prose(120, 1), prose(60, 2)
    rows = [(i, edited(base, 0.03, i)) for i in range(60)]
    rows += [(100 + i, prose(50, 1000 + i // 2) + " " + passage + f" {i}") for i in range(60)]
    rows += [(300 + i, passage) for i in range(20)]
    check(spark, rows, small_group=3)
    check(spark, rows, small_group=3, sample_docs=1)


def test_random_pairs_near_the_threshold(spark):
    rows = []
    for p in range(120):
        text = prose(random.Random(p).randint(5, 60), p)
        words = text.split()
        cut = len(words) * random.Random(p + 1).randint(70, 100) // 100
        rows += [(2 * p, text), (2 * p + 1, " ".join(words[:cut]).upper())]
    check(spark, rows)


def test_join_edges(spark):
    docs = documents(spark)
    got = jaccard.join(docs).collect()
    assert len(got) == docs.count()
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = brute_components(list(rows.items()))
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert jaccard.join(empty(spark)).collect() == []
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert set(ids) == {d for d, (_, c) in want.items() if d == c}


def test_word_hashes_follow_the_word_rule():
    texts = ["", "  ", "a B\tc\x0bd\x0ce\rf\ng", "É é İ　x\u0085y A", "tail ", "one two three"]
    for t, h in zip(texts, word_hashes([t.encode() for t in texts]), strict=True):
        words = WORD.findall(t.translate(LOWER))
        assert len(h) == len(words)
        assert len(set(h.tolist())) == len(set(words))
        assert len(shingle_hashes(h)) == len(shingles(t))


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 300, 1000]:
        for _ in range(8):
            pool = rng.integers(0, 1 << 63, 2 * n + 4).astype(np.uint64)
            a = np.unique(pool[:n])
            m = int(rng.integers(n, 4 * n // 3 + 1))
            drop = max(0, (n + m) // 7 - (m - n)) // 2
            b = np.unique(np.concatenate([a[drop:], pool[n : m + drop]]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 75 * (len(a) + len(b) - inter):
                for frequent in (np.zeros(0, np.uint64), a[::2], a):
                    assert np.intersect1d(jaccard.keys_of(a, np.sort(frequent)), jaccard.keys_of(b, np.sort(frequent))).size


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}


def brute_repeats(rows, length):
    places = collections.Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        places.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_against_brute_force(spark):
    rng, rows = random.Random(9), []
    passage, line = prose(70, 50), prose(25, 51) + "\n"
    for i in range(60):
        text = prose(rng.randint(0, 150), i)
        if i % 3 == 0:
            a = rng.randint(0, 100)
            text = text[:a] + passage[rng.randint(0, 20) : rng.randint(150, 400)] + text[a:]
        if i % 5 == 0:
            text += line * rng.randint(1, 4)
        rows.append((i, text))
    rows += [(100, "ab" * 400), (101, "a" * 199), (102, "a" * 200), (103, "a" * 201), (104, None), (105, ""), (106, rows[7][1]), (106, rows[7][1])]
    rows += [(200 + i, "é" * (90 + i)) for i in range(20)] + [(None, passage)]
    for length in (200, 80):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = collections.Counter(map(tuple, substrings.remove_repeats(docs, length).collect()))
        assert got == brute_repeats(rows, length)


def test_repeats_edges(spark):
    docs = documents(spark)
    got = collections.Counter(map(tuple, substrings.remove_repeats(docs).collect()))
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 200)
    assert substrings.remove_repeats(empty(spark)).collect() == []


def test_a_passage_in_unlike_contexts_meets_in_no_task(spark):
    passage = prose(90, 5)
    rows = [(i, prose(60, 100 + i) + passage[i % 40 :] + (passage[: 150 + i] if i % 3 else "") + prose(60, 300 + i)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length in (64, 100, 200):
        got = collections.Counter(map(tuple, substrings.remove_repeats(docs, length).collect()))
        assert got == brute_repeats(rows, length)
    plan = substrings.repeated_spans(docs.selectExpr("doc_id as node", "text"), 200)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for upper, lower in zip(lines, lines[1:], strict=False):  # Python gets rows of a text or of a run, never of a gram
        assert not ("MapInArrow" in upper and "hashpartitioning(gram" in lower)


def test_sliding_min():
    rng = np.random.default_rng(2)
    for n, w in ((5, 5), (9, 2), (100, 7), (64, 64), (137, 10)):
        x = rng.integers(0, 1000, n).astype(np.uint64)
        assert substrings._sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]


def test_no_unbounded_plans(spark):
    docs = documents(spark).where(F.lit(True))
    plan = jaccard.join(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Cartesian|NestedLoop", plan)


def test_long_regular_words_hash_apart():
    """The two Thue-Morse words of 1,024 characters: sums of powers modulo 2**64 cannot tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    hx, hy = (h[0] for h in word_hashes([x.encode(), y.encode()]))
    assert hx != hy and word_hashes([x.upper().encode()])[0][0] == hx


def test_outsiders_meet_every_other_component(spark, monkeypatch):
    """Groups in many components, over several blocks: same result as brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "CLOSEST", 1)
    base = prose(90, 11)
    rows = [(i, edited(base, 0.035, 500 + i)) for i in range(70)]
    rows += [(200 + i, edited(edited(base, 0.05, 7), 0.02, 900 + i)) for i in range(40)]
    check(spark, rows, small_group=2)
