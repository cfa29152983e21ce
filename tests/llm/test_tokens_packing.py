from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest
from llm.helpers import documents, edge_texts, empty, prose

from ledgerscope.llm import packing, tokens
from ledgerscope.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path()
REFERENCE = tokenizers.Tokenizer.from_file(PATH)


def reference_ids(texts):
    return [e.ids for e in REFERENCE.encode_batch_fast(texts, add_special_tokens=False)]


def test_ids_equal_the_library_on_random_strings():
    rng = random.Random(3)
    alphabets = [
        [*"ab'sre tT.\n\n  \t é9'!<|", "<|endoftext|>", "\r\n", "　", "日", "\x1c", "\u0085", "'re"],
        [*"0123456789abcdef"], [*"ab"], [*"=-_*. \n"], [chr(i) for i in range(32, 0x2000)],
    ]
    for letters in alphabets:
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
        found = tokens.token_bytes(texts, PATH, cache_size=500)  # small, so that the cache turns over
        assert [np.frombuffer(b, "<u4").tolist() for b in found] == reference_ids(texts)


def test_ids_equal_the_library_around_every_code_point():
    texts = [f"a{chr(i)}b {chr(i)}{chr(i)} c" for i in range(0, 0x30000) if not 0xD800 <= i < 0xE000]
    found = tokens.token_bytes(texts, PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == reference_ids(texts)


def test_ids_equal_the_library_on_long_white_space():
    n = 2_000_000
    texts = [" " * n, "a" + "\n" * n + "b", "a b " + "\t" * n + " c d", "x\ty" + " \r\n" * (n // 3) + "<|endoftext|>z", " " * 150_000 + "a", "　" * (n // 2)]
    found = tokens.token_bytes(texts, PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == reference_ids(texts)


def test_units_concatenate_to_the_text():
    for t in edge_texts():
        assert "".join(tokens.units_of(t or "")) == (t or "")


def test_counts(spark):
    docs = documents(spark)
    got = collections.Counter(map(tuple, tokens.count_tokens(docs, PATH, limit=100).collect()))
    want = collections.Counter()
    for r in docs.collect():
        t = r["text"] or ""
        n = len(reference_ids([t])[0])
        want[r["doc_id"], len(t.encode()), n, n > 100] += 1
    assert got == want
    assert tokens.count_tokens(empty(spark), PATH).collect() == []


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)]
    assert packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("open_bins", [1, 3, 1000])
def test_packer_is_gapless_and_never_overfull(open_bins):
    rng = random.Random(1)
    p, bins = packing.Packer(64, open_bins), collections.defaultdict(list)
    for _ in range(3000):
        n = rng.randint(1, 64)
        b, offset = p.place(n)
        bins[b].append((offset, n))
        assert p.n_open <= open_bins
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 64


def test_pack_documents_round_trip(spark):
    docs = documents(spark)
    got = packing.pack_documents(docs, PATH, size=128).collect()
    texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    copies = collections.Counter(r["doc_id"] for r in docs.collect())
    ids = {d: [*reference_ids([t])[0], 2] for d, t in texts.items()}
    assert sum(r["length"] for r in got) == sum(len(ids[d]) * n for d, n in copies.items())
    for r in got:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        assert r["length"] == 128 or r["piece"] == 0
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in places.values():
        ends = [o + n for o, n in sorted(placed)]
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]]
        assert ends[-1] <= 128
    assert packing.pack_documents(empty(spark), PATH).collect() == []


def test_packing_is_near_the_lower_bound(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng.randint(5, 900), i)) for i in range(1500)], "doc_id long, text string")
    total = packing.total_sequences(packing.pack_documents(docs, PATH)).first()
    assert total["sequences"] <= 1.01 * total["tokens"] / 1024 + 1


def naive_best_fit(lengths, size, open_bins):
    """Bin and offset of each piece by looking at every open bin; ties: the bin opened or used last."""
    free, out = {}, []  # open bins in order of last use
    count = 0
    for n in lengths:
        fitting = [b for b in free if free[b] >= n]
        if fitting:
            least = min(free[b] for b in fitting)
            b = [b for b in fitting if free[b] == least][-1]
            room = free.pop(b)
        else:
            if len(free) >= open_bins:
                fullest = min(free.values())
                del free[[b for b in free if free[b] == fullest][-1]]
            b, room, count = count, size, count + 1
        out.append((b, size - room))
        if room > n:
            free[b] = room - n
    return out


@pytest.mark.parametrize("open_bins", [1, 2, 7, 500])
def test_packer_is_best_fit(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.randint(1, 40) for _ in range(800)]
    p = packing.Packer(40, open_bins)
    assert [p.place(n) for n in lengths] == naive_best_fit(lengths, 40, open_bins)


def test_open_bins_are_bounded_in_effect():
    """The bound that queries use is reached on long runs of half-full pieces."""
    p = packing.Packer(1024, 1024)
    for _ in range(3000):
        p.place(600)
    assert p.n_open == 1024


def test_groups_keep_their_sequences_in_any_partition(spark):
    """Groups that end up in one task do not share sequence numbers."""
    rows = [(i, 0, 0, 1 + i * 37 % 100, i) for i in range(2000)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    for parts in (1, 3):
        packed = packing.pack(pieces, size=100, group_rows=100).coalesce(parts).collect()
        assert len(packed) == 2000
        places = collections.defaultdict(list)
        for r in packed:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for placed in places.values():
            ends = [o + n for o, n in sorted(placed)]
            assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 100
        assert len(places) <= 1.1 * sum(r[3] for r in rows) / 100
