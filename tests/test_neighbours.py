"""Nearest neighbours, cross mapping and twin walks against all distances."""

import time

import numpy as np
import pytest

from seqsieve.operators import neighbours, resampling, statistics


def noise(n, seed):
    return np.random.default_rng(seed).normal(size=n)


def plain(held, held_ids, asked, ids, k, theiler):
    """All distances; ties by id."""
    d = np.sqrt(((asked[:, None] - held[None]) ** 2).sum(2))
    d[np.abs(ids[:, None] - held_ids[None]) <= theiler] = np.inf
    out = []
    for row in d:
        order = [j for j in np.argsort(row, kind="stable")[:k] if np.isfinite(row[j])]
        out.append((held_ids[order].tolist(), row[order].tolist()))
    return out


def plain_ccm(x, y, dim=3):
    n, best = len(y) - dim + 1, 0.0
    w, ids = np.stack([y[i : i + n] for i in range(dim)], 1), np.arange(n)
    for size in neighbours.sizes(n, dim):
        found = plain(w[:size], ids[:size], w, ids, dim + 1, 0)
        weights = [np.exp(-np.array(d) / max(d[0], 1e-12)) for _, d in found]
        guess = np.array([(v * x[near]).sum() / v.sum() for (near, _), v in zip(found, weights)])
        if guess.std() > 0:
            best = max(best, float(np.corrcoef(guess, x[:n])[0, 1]))
    return best


def points(kind, n, dim, seed):
    rng = np.random.default_rng(seed)
    return {"normal": rng.normal(size=(n, dim)), "ties": rng.integers(0, 4, (n, dim)).astype(float), "one": np.zeros((n, dim)), "wide": rng.standard_cauchy((n, dim)), "hot": np.where(rng.random((n, 1)) < 0.4, 1.0, rng.normal(size=(n, dim)))}[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "one", "wide", "hot"])
def test_tree(kind):
    for seed, (n, dim, k, theiler) in enumerate([(1, 2, 3, 0), (9, 1, 4, 1), (60, 3, 10, 3), (400, 2, 4, 0), (1500, 3, 4, 1)]):
        p, ids, m = points(kind, n, dim, seed), np.arange(n), max(1, n * 2 // 3)
        near, dist = neighbours.library(p[:m], ids[:m], k, theiler).nearest(p, ids, k, theiler)
        for a, d, (want, far) in zip(near, dist, plain(p[:m], ids[:m], p, ids, k, theiler)):
            assert a[a >= 0].tolist() == want and d[a >= 0].tolist() == far


@pytest.mark.parametrize("kind", ["normal", "ties", "one", "hot"])
def test_cells(spark, kind):
    """A cell of 64 points and few queries a task, so that most lists are merged from several cells."""
    n, k = 900, 4
    p, ids = points(kind, n, 3, 5), np.arange(n)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, p)], "id long, v array<double>").repartition(4)
    got = {r.id: (r.near, r.dist) for r in neighbours.nearest(rows.where("id < 700"), rows, k, theiler=1, cell=64).collect()}
    want = plain(p[:700], ids[:700], p, ids, k, 1)
    assert got == {i: (near, pytest.approx(far)) for i, (near, far) in enumerate(want)}


def test_few_points(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id long, v array<double>")
    got = {r.id: r.near for r in neighbours.nearest(rows, rows, 4).collect()}
    assert got == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert neighbours.nearest(rows.where("id < 0"), rows, 4).where("size(near) = 0").count() == 3


def test_cross_mapping(spark):
    x = noise(220, 4)
    y = 0.7 * np.concatenate(([0], x[:-1])) + 0.3 * noise(220, 5)
    ball = np.random.default_rng(1).integers(1, 6, 220).astype(float)
    for a, b in ((x, y), (y, x), (x, ball), (ball, y)):
        want = plain_ccm(a, b)
        assert neighbours.ccm_packed(a, b) == pytest.approx(want, abs=1e-12) == statistics.TESTS["ccm"][0](a, b)
    rows = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))], "t long, x double, y double").repartition(3)
    assert neighbours.ccm(rows, cell=32).first().stat == pytest.approx(plain_ccm(x, y), abs=1e-12)
    assert neighbours.ccm(rows.where("t < 10")).first().stat is None and np.isnan(neighbours.ccm_packed(x[:10], y[:10]))


def test_cross_mapping_asks_equal_points_once(spark, monkeypatch):
    """Series of few values, all libraries small or most of them parted into cells; rows without x are told but not compared."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 5, 700).astype(float)
    y[100:300] = 2.0
    x = np.roll(y, 1) + rng.integers(0, 3, 700) + 1000.0
    seen, kept = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, label: seen.append((label, kept(df, label))) or seen[-1][1])
    rows = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))], "t long, x double, y double").repartition(3)
    different = len({tuple(v) for v in np.lib.stride_tricks.sliding_window_view(y, 3).tolist()})
    for cell in (32, 1 << 12):
        assert neighbours.ccm(rows, cell=cell).first().stat == pytest.approx(plain_ccm(x, y), abs=1e-10)
    asked = [df.count() for label, df in seen if label in ("asked", "queries")]
    assert asked[0] == different and max(asked) == different < 200
    near = rng.normal(size=200) * 1e-200  # distances that are zeros, of points that differ
    some = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, near))], "t long, x double, y double")
    assert neighbours.ccm(some, cell=32).first().stat == pytest.approx(plain_ccm(x[:200], near), abs=1e-10)
    assert neighbours.ccm(rows.withColumn("x", rows.t * 0 + 0.1)).first().stat == 0


def test_cross_mapping_without_some_values(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=90), rng.integers(0, 3, 90).astype(float)
    x[::7] = np.nan
    best, w, ids = 0.0, np.stack([y[i : i + 88] for i in range(3)], 1), np.arange(88)
    for size in neighbours.sizes(88, 3):
        guess = []
        for near, d in plain(w[:size], ids[:size], w, ids, 4, 0):
            v = np.exp(-np.array(d) / max(d[0], 1e-12))
            guess.append(np.nansum(v * x[near]) / v.sum())
        there = ~np.isnan(x[:88])
        best = max(best, float(np.corrcoef(np.array(guess)[there], x[:88][there])[0, 1]))
    rows = spark.createDataFrame([(t, None if np.isnan(a) else float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))], "t long, x double, y double")
    for cell in (32, 1 << 12):
        assert neighbours.ccm(rows, cell=cell).first().stat == pytest.approx(best, abs=1e-12)


def test_work_is_about_linear():
    took = []
    for n in (4000, 16_000, 64_000):
        began = time.process_time()
        neighbours.twin_table(noise(n, 1))
        took.append(time.process_time() - began)
    assert took[2] < 9 * took[1] and took[1] < 9 * took[0]  # four times the points each; 16 times if quadratic


def test_twin_walks():
    x = np.round(noise(25_157, 1), 1)
    began = time.process_time()
    table = neighbours.twin_table(x)
    walks = [resampling.twin_surrogate(x, np.random.default_rng(i), table=table) for i in range(3)]
    assert time.process_time() - began < 60
    states = {tuple(s) for s in np.lib.stride_tricks.sliding_window_view(x, 1)}
    for w in walks:
        assert len(w) == len(x) and {(v,) for v in w} <= states and abs(w.std() - x.std()) < 0.1
    assert not np.array_equal(walks[0], walks[1])
    # the same walk as by looking at all states in each step
    y = noise(150, 2)
    rng = np.random.default_rng(5)
    n, m, many = len(y) - 2, 3, 10
    w = np.lib.stride_tricks.sliding_window_view(y, m)
    at, anew, picks = int(rng.integers(n)), rng.integers(0, n, len(y)), rng.integers(0, many, len(y))
    out = []
    for again, pick in zip(anew, picks):
        out.append(y[at])
        d = np.sqrt(((w - w[at]) ** 2).sum(1))
        d[max(0, at - 1) : at + 2] = np.inf
        at = int(np.argsort(d, kind="stable")[pick]) + 1
        at = int(again) if at >= n else at
    assert resampling.twin_surrogate(y, np.random.default_rng(5)).tolist() == out


def test_boxes_answer_as_all_distances_do(monkeypatch):
    monkeypatch.setattr(neighbours, "PAIRS", 1 << 10)
    rng, kinds = np.random.default_rng(5), ("normal", "lattice", "equal", "far")
    for trial in range(48):
        n, q, dim, k, theiler = (int(rng.integers(a, z)) for a, z in ((1, 300), (1, 200), (1, 5), (1, 12), (0, 3)))
        made = {"normal": lambda m: rng.normal(size=(m, dim)), "lattice": lambda m: rng.integers(0, 4, (m, dim)) / 6, "equal": lambda m: np.full((m, dim), 2.5), "far": lambda m: rng.standard_cauchy((m, dim))}[kinds[trial % 4]]
        points, asked, ids, own = made(n), made(q), rng.permutation(1000)[:n], rng.permutation(1000)[:q]
        within = None if trial % 3 else rng.exponential(1, q)
        monkeypatch.setattr(neighbours, "CROWD", 20 if trial % 2 else 1 << 12)
        near, dist = neighbours.Tree(points, ids).nearest(asked, own, k, theiler, within)
        d = np.sqrt(sum((asked[:, i : i + 1] - points[:, i]) ** 2 for i in range(dim)))
        d[(np.abs(own[:, None] - ids) <= theiler) | (d > (np.inf if within is None else within[:, None]))] = np.inf
        for i in range(q):
            want = [j for j in np.lexsort((ids, d[i]))[:k] if np.isfinite(d[i, j])]
            assert near[i].tolist() == ids[want].tolist() + [-1] * (k - len(want)), (trial, kinds[trial % 4])
            assert dist[i, : len(want)] == pytest.approx(d[i, want], rel=1e-12)


def test_equal_states_share_a_row_of_the_twin_table():
    x, asked = np.random.default_rng(7).integers(0, 3, 2000).astype(float), []
    plain = neighbours.Tree.nearest
    neighbours.Tree.nearest = lambda self, points, *a: asked.append(len(points)) or plain(self, points, *a)
    try:
        table = neighbours.twin_table(x)
    finally:
        neighbours.Tree.nearest = plain
    assert max(asked) <= 27
    w = np.lib.stride_tricks.sliding_window_view(x, 3)
    for i in range(0, 1998, 97):
        d = np.sqrt(((w - w[i]) ** 2).sum(1))
        d[max(0, i - 1) : i + 2] = np.inf
        assert table[i].tolist() == np.argsort(d, kind="stable")[:10].tolist()
