"""Near-duplicate vectors against all pairs, and the index's parts on their own."""

from __future__ import annotations

import math

import numpy as np
import pytest
from ledgerscope.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int, n string, node string, list string, kept string"


def brute(rows, threshold=0.98):
    """Per row (links, component), in row order."""
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links, parent = [0] * n, list(range(n))
    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    arrays = [np.array(v, np.float32).astype(float) / np.abs(np.array(v, np.float32).astype(float)).max() if usable(v, lab) else None for _, v, lab in rows]
    for i in range(n):
        for j in range(i):
            x, y = arrays[i], arrays[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, (vec_id, *_) in enumerate(rows):
        known = least.get(top(i))
        least[top(i)] = vec_id if known is None else known if vec_id is None else min(known, vec_id)
    return sorted(((rows[i][0], links[i], least[top(i)], rows[i][0] == least[top(i)]) for i in range(n)), key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z", "k") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in neardup.near_duplicates(df, **more).collect()), key=str)


def vectors(seed, groups, noise, dims=64, size=8):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, size))):
            v = centre + noise * rng.normal(size=dims)
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    return rows


def test_all_pairs_of_random_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_ROWS", 20)
    rows = vectors(1, 120, 0.12)
    truth = brute(rows)
    assert sum(n for _, n, _, _ in truth) > 100
    assert found(spark, rows) == truth


def test_lists_are_cut_into_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + 0.1 * rng.normal(size=16)], 1) for i in range(150)]  # one dense list
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]  # and a hot vector
    assert found(spark, rows, block=16) == brute(rows)


def test_edges(spark):
    nan, inf, big = float("nan"), float("inf"), 3e38
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None),
        (9, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (None, [1.0, 0.1], 1), (None, [0.0, 1.0], 3), (None, [0.0, 1.0], 3),
        (9, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (13, [big, big], 4), (14, [1.0, 1.0], 4), (15, [1e-40, 1e-40], 4), (16, [-0.0, 1.0], 1), (17, [-1.0, 0.0], 1),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_threshold_is_exact(spark):
    """Pairs within a millionth of the threshold fall on the right side."""
    rows = []
    for k, cosine in enumerate([0.98 - 1e-6, 0.98 + 1e-6]):
        a = math.acos(cosine)
        rows += [(2 * k, [1.0, 0.0], k), (2 * k + 1, [math.cos(a), math.sin(a)], k)]
    assert [n for _, n, _, _ in found(spark, rows)] == [0, 0, 1, 1]


def test_code_errors_bound_the_table_distance():
    rng = np.random.default_rng(3)
    x = neardup.unit(rng.normal(size=(2000, 32)))
    index = neardup.Index.fit(x, 20)
    lists, probes = index.assign(x, 0.1)
    codes, errors = index.encode(x, lists)
    for of in range(len(index.centres)):
        inside = np.flatnonzero(lists == of)
        tables = index.tables(x[:50], of)
        table = np.sqrt(np.maximum(sum(tables[m][:, codes[inside, m]] for m in range(len(tables))), 0))
        true = np.sqrt(((x[:50, None] - x[None, inside]) ** 2).sum(2))
        assert (np.abs(table - true) <= errors[inside] + 1e-6).all()
    assert all((p < own).all() for p, own in zip(probes, lists, strict=True))


@pytest.mark.parametrize("dims", [8, 64])
def test_probes_reach_the_neighbours(dims):
    rng = np.random.default_rng(4)
    x = neardup.unit(rng.normal(size=(4000, dims)))
    step = rng.normal(size=x.shape)
    y = neardup.unit(x + 0.199 * step / np.sqrt((step**2).sum(1))[:, None])
    index = neardup.Index.fit(x, 200)
    slack = 0.2 * min(1.0, neardup.SIGMAS / math.sqrt(dims))
    a, pa = index.assign(x, slack)
    b, pb = index.assign(y, slack)
    met = [i == j or (j in p) or (i in q) for i, j, p, q in zip(a, b, pa, pb, strict=True)]
    assert np.mean(met) >= (1.0 if dims == 8 else 0.999)


def test_recall_on_the_given_table(spark):
    """Every link of the supplied vectors is found."""
    import duckdb

    table = duckdb.sql("SELECT vec_id, embedding, label FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    rng = np.random.default_rng(6)
    for i in range(300):  # the small table has no near copies: plant some
        _, v, label = table[int(rng.integers(0, 2000))]
        table.append((10_000 + i, [float(np.float32(x)) for x in np.array(v) + rng.normal(size=64) * 0.012], label))
    by_label = {}
    for vec_id, v, label in table:
        by_label.setdefault(label, []).append((vec_id, v, label))
    truth = [r for rows in by_label.values() for r in brute(rows)]
    got = found(spark, table)
    assert sum(n for _, n, _, _ in truth) >= 500
    assert sum(n for _, n, _, _ in got) >= 0.99 * sum(n for _, n, _, _ in truth)
    assert {r[0] for r in got} == {r[0] for r in truth}
