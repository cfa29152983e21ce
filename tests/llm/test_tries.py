"""The conversation trie against a walk over all prefixes, and running sums across partitions."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from ledgerscope.llm import ordered, tries

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, depth string, node string, place int"


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    for c in own:
        own[c] = [(r, t) for _, _, r, t in sorted(own[c], key=lambda x: (x[0], x[1], digest(x[2], x[3])))]
    members, ending = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100  # the remainder has the sign of the id
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ending.setdefault(path, []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = {}
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) if below else 1
        saved[path] = sum(saved[k] for k in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        out[(min(members[path]), len(path))] = (
            min(members[path[:-1]]) if path else None, len(members[path]), len(below), leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ending.get(path, [])))).encode()).hexdigest(),
        )
    return out


def got(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


def check(spark, rows):
    result = tries.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = got(result)
    assert result.count() == len(found)
    assert found == brute(rows)


def row(conv, turn, role, text):
    return (conv, turn, role, text, "x", "y", "z", 1)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(0, 320, 3), *range(100, 500, 100)]:
        for turn in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append(row(conv, turn, rng.choice(["user", "bot"]), rng.choice(["hi", "yes", "no, thanks", "é" * 3])))
    check(spark, rows)


def test_edges(spark):
    rows = [
        row(None, 0, "user", "no id"), row(1, None, "user", "null turn first"), row(1, 3, None, None), row(1, 3, "bot", "tie"), row(1, 3, "bot", "tie"),
        row(2, 1, "user", ""), row(-105, 1, "user", "negative"), row(-100, 1, "bot", "negative base"), row(-100, 2, "bot", "more"),
        row(307, 0, "user", "absent base"), row(100, 0, "user", "b" * 300_000), row(101, 5, "user", "x"), row(101, 9, "user", "y"), row(101, 10, "user", "z"),
    ]
    check(spark, rows)
    check(spark, [row(6, 0, "user", "alone")])


def test_empty_table(spark):
    assert tries.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_conversation_and_hot_first_turn(spark):
    """One conversation of a third of all rows, one first turn in most others, many exact copies."""
    rows = [row(7, t, "user", f"turn {t % 11}") for t in range(3000)]
    rows += [row(c, t, "user", f"turn {t}") for c in range(1000, 3000) for t in range(2)]
    rows += [row(c, 7, "user", f"own {c}") for c in range(1000, 3000, 2)]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_running_sums_cross_partitions(spark, seed):
    rng = random.Random(seed)
    sizes = rng.choice([[900], [1] * 300, [5, 400, 1, 300, 2, 2]])
    rows = [(k, i, rng.randrange(-(2**63), 2**63)) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(4)
    found = {(r["k"], r["i"]): (r["before_x"], r["upto_x"]) for r in ordered.running(df, "k", ["i"], ["x"], "sums").collect()}
    total = {}
    wrap = lambda v: (v + 2**63) % 2**64 - 2**63
    for k, i, x in rows:
        before = total.get(k, 0)
        total[k] = wrap(before + x)
        assert found[(k, i)] == (before, total[k])


def test_long_list_of_ends_is_streamed(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 50)
    check(spark, [row(c, 0, "user", "same") for c in range(500)])
