"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from tarnwick.llm import embedding_dedup


def by_force(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = [i for i, _ in good], np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    up = {i: i for i, _ in rows}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in zip(*np.nonzero(s), strict=True):
        p, q = top(ids[a]), top(ids[b])
        up[max(p, q)] = min(p, q)
    n = dict(zip(ids, s.sum(1).tolist(), strict=True))
    return {i: (n.get(i, 0), top(i), top(i) == i) for i, _ in rows}


@pytest.mark.parametrize("options", [{}, {"cell_rows": 20, "block_rows": 16}, {"cell_rows": 10}])
def test_near_dedup(spark, options):
    rng, rows = np.random.default_rng(1), []
    for _ in range(40):
        base = rng.normal(size=64)
        for _ in range(rng.choice([1, 2, 20])):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.choice([0, 0.1, 0.25, 0.33])).tolist()))
    rows += [(len(rows) + k, v) for k, v in enumerate([None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3, rows[5][1], rows[5][1]])]
    want = by_force(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect()}
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and set(got) == set(want)


def test_nothing_to_compare(spark):
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    (r,) = embedding_dedup.near_dedup(spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")).collect()
    assert (r["n_links"], r["component_id"], r["kept"]) == (0, 3, True)


@pytest.mark.parametrize("options", [{}, {"cell_rows": 4}])
def test_every_length_is_compared(spark, options):
    rng, rows = np.random.default_rng(3), []
    for length, n in ((64, 30), (16, 12), (3, 5)):
        base = rng.normal(size=length)
        rows += [(len(rows) + k, (base + rng.normal(size=length) * 0.05).tolist()) for k in range(n)]
    rows += [(100, [1.0]), (101, [2.0]), (102, [-1.0]), (103, [0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect()}
    want = {i: (29, 0) for i in range(30)} | {i: (11, 30) for i in range(30, 42)} | {i: (4, 42) for i in range(42, 47)} | {100: (1, 100), 101: (1, 100), 102: (0, 102), 103: (0, 103)}
    assert got == want


@pytest.mark.parametrize("options", [{}, {"cell_rows": 4}])
def test_very_large_and_small_vectors(spark, options):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [0.0, 5e-324]), (5, [0.0, 1e308]), (6, [-1e-300, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_recall_of_the_hardest_pairs():
    """Pairs of a cosine of 0.9 among vectors without any structure."""
    rng = np.random.default_rng(5)
    x = embedding_dedup._unit(rng.normal(size=(20_000, 64)))
    cells = embedding_dedup.Cells.fit(0, x[:8192], 9)
    u = x[:1000]
    g = rng.normal(size=u.shape)
    y = 0.9 * u + np.sqrt(0.19) * embedding_dedup._unit(g - (g * u).sum(1, keepdims=True) * u)
    a, b = cells.of(u), cells.of(y)
    assert a.shape == (1000, 16) and ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() > 0.95


def test_a_large_cell_is_dealt_out(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.02).tolist()) for i in range(300)]
    got = embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell_rows=50, block_rows=40).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}
