"""What larger tables brought up: ties that depend on the order of rows, vectors that cancel, keys by the hundred thousand."""

import hashlib
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqsieve.functions import signals
from seqsieve.operators import evaluation, forecast, neighbours, resampling, scans, series, statistics, transforms
from seqsieve.plans import gate_queries


def test_a_value_at_its_users_mean_is_not_above_it(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    orders = {1: (0.1, 0.2, 0.3), 2: (0.3, 0.2, 0.1), 3: (0.2, 0.3, 0.1), 4: (1e40, 1.0, 1.0)}  # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ
    spark.createDataFrame([(u, t, v) for u, vs in orders.items() for t, v in zip("abc", vs)], "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    got = {(r.user_id, r.event_type): r.p_raw for r in gate_queries._user_p(spark, folder).collect()}
    assert got == {(u, t): (1 + (v > (0.2 if u < 4 else 1e39))) / 2 for u, vs in orders.items() for t, v in zip("abc", vs)}


def test_angles_of_vectors_that_cancel(spark):
    reds = [sorted((a, a + 11, a + 22, b, b + 11, b + 22)) for a in range(1, 12) for b in range(a + 1, 12)]
    rows = spark.createDataFrame([(t, r, 1) for t, r in enumerate(reds)], "t long, reds array<int>, blue int").select("t", signals.column("vector_phase").alias("x")).orderBy("t").collect()

    def angle(r):
        total = {}
        for f in (math.sin, math.cos):
            total[f] = 0.0
            for v in r:
                total[f] += f(v * 2 * math.pi / 33)
        return math.atan2(total[math.sin], total[math.cos])

    assert [r.x for r in rows] == pytest.approx([angle(r) for r in reds], abs=1e-9)


def test_windows_together_equal_windows_apart(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(1000):
        reds = sorted((rng.choice(32, 6, replace=False) + 1).tolist())
        if 300 <= t < 420 and t % 60 < 45:  # a ball that follows itself, and drifts
            reds[5] = 33
        rows.append((t, reds, int(rng.integers(1, 17))))
    d = spark.createDataFrame(rows, "t long, reds array<int>, blue int")
    apart = scans.ball_drift_scan(scans.windows(d, 1000), k=40, seed=7, keys=["w"])
    want = {r.w: r.sig for r in apart.groupBy("w").agg((F.least(F.min("q_drift"), F.min("q_momentum")) < 0.9).cast("int").alias("sig")).collect()}
    got = {r.w: r.sig for r in scans.window_verdicts(d, 1000, k=40, seed=7, q=0.9).collect()}
    assert got == want and set(got.values()) == {0, 1}
    plan = scans.window_verdicts(d, 1000, k=40, seed=7)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1  # draws move once; surrogates and windows' totals never


def test_packed_walks_equal_walks_by_rows(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(t, sorted((rng.choice(33, 6, replace=False) + 1).tolist())) for t in range(1300)], "t long, reds array<int>")
    for knobs in ({}, {"train_n": 40, "decay": 0.5}):
        want = sorted(map(tuple, forecast.walk_hits(resampling.shuffled(d, 5, 4), ["sid"], **knobs).select("sid", "n", "hits").collect()))
        assert sorted(map(tuple, forecast.shuffled_walk_hits(d, 5, 4, **knobs).collect())) == want
    assert forecast.shuffled_walk_hits(d.where("t < 320"), 5, 4).count() == 0


def test_numpy_hashes_and_orders(spark):
    for seed, sid, n in ((0, 0, 1), (-3, 199, 20_011), (10**30, 10**30, 12)):
        high, low = resampling.digests(seed, sid, n)
        for t in {0, 9, 10, 9_999, 16_383, 16_384, n - 1} & set(range(n)):
            assert (int(high[t]) << 64 | int(low[t])) == int(hashlib.md5(f"{seed}:{sid}:{t}".encode()).hexdigest(), 16)
    orders: dict = {}
    for sid in range(5):
        resampling.surrogate([np.arange(50.0)], "iaaft", 1, "a", sid, orders)
    assert len(orders) == 1  # what earlier surrogates needed is not kept


def test_sums_of_products_equal_correlations():
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=300) + 1e4, rng.integers(0, 2, 50).astype(float), np.r_[np.zeros(40), 1.0], np.r_[5.0, np.full(40, 7.1)], np.full(30, 0.1)):
        parts = [(x[:-lag], x[lag:]) for lag in range(1, 6)]
        want = max(abs(np.corrcoef(a, b)[0, 1]) if np.ptp(a) > 0 and np.ptp(b) > 0 else 0.0 for a, b in parts)
        got = statistics.np_acf_max(x, 5)
        assert got == pytest.approx(want, abs=1e-9) or np.ptp(x) == 0


def test_equal_points_ask_once():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=400), rng.integers(0, 4, 400).astype(float)
    n, asked = 398, []
    w, best = np.stack([y[i : i + n] for i in range(3)], 1), 0.0
    for size in neighbours.sizes(n, 3):
        d = np.sqrt(((w[:, None] - w[None, :size]) ** 2).sum(2))
        d[np.arange(size), np.arange(size)] = np.inf
        near = np.argsort(d, 1, kind="stable")[:, :4]
        dist = np.take_along_axis(d, near, 1)
        weight = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
        best = max(best, np.corrcoef((weight * x[near]).sum(1) / weight.sum(1), x[:n])[0, 1])
    plain = neighbours.Tree.nearest
    neighbours.Tree.nearest = lambda self, points, *a: asked.append(len(points)) or plain(self, points, *a)
    try:
        assert neighbours.ccm_packed(x, y) == pytest.approx(best, abs=1e-12)
    finally:
        neighbours.Tree.nearest = plain
    assert max(asked) <= 64  # 4 ** 3 different points of 398


def test_packed_balls_equal_balls_by_rows(spark):
    rng = np.random.default_rng(8)
    d = spark.createDataFrame([(t, sorted((rng.choice(33, 6, replace=False) + 1).tolist()), int(rng.integers(1, 17))) for t in range(301)], "t long, reds array<int>, blue int")
    rows = lambda df: {(r.sid, r.colour, r.ball): (r.drift, r.momentum) for r in df.collect()}
    want, got = rows(scans.ball_stats(resampling.shuffled(d, 3, 5), ["sid"])), rows(scans.shuffled_ball_stats(d, 3, 5))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("n", [4099, 3 * 4099, 22 * 2287, 4 * 1031])
def test_transforms_of_lengths_with_large_primes(n):
    x = np.random.default_rng(n).normal(size=n)
    want = np.fft.rfft(x)
    assert np.abs(transforms.rfft(x) - want).max() < 1e-11 * np.abs(want).max()
    want[0] += 3j  # numpy takes no notice of it
    assert np.abs(transforms.irfft(want, n) - np.fft.irfft(want, n)).max() < 1e-11


def test_orders_that_are_sorted_by_their_upper_bits():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 60, 900).astype(np.uint64) + (np.uint64(1) << np.uint64(40)) * rng.integers(0, 3, 900).astype(np.uint64)
    then = rng.integers(0, 4, 900).astype(np.uint64)
    assert (resampling.ranked(keys) == np.argsort(keys, kind="stable")).all() and (resampling.ranked(keys, then) == np.lexsort((then, keys))).all()
    y = np.concatenate([rng.normal(size=500), [0.0, -0.0, 0.0, -1e-300, 5.0, 5.0]])
    assert (resampling.ordered(y) == np.argsort(y, kind="stable")).all()


@pytest.mark.parametrize("maxlag, bins", [(20, 12), (1, 6), (45, 20)])
def test_lagged_pairs_counted_by_threes(maxlag, bins):
    code = np.random.default_rng(maxlag).integers(0, bins, 40_000)
    for lag, found in statistics._pairs_of_bins(code, bins, range(1, maxlag + 1)).items():
        assert (found == np.bincount(code[:-lag] * bins + code[lag:], minlength=bins * bins).reshape(bins, bins)).all()


def test_values_are_moved_in_narrow_forms():
    for values, form in (([0, 255.0], 0), ([-3.0, 256], 1), ([0.5, 1], 2), ([np.nan, 1], 2), ([40_000.0], 2), ([-0.0, 1], 2)):
        made = statistics.as_bytes(np.array(values))
        assert made[0] == form and np.array_equal(statistics.of_bytes([made]).astype(float), np.array(values, float), equal_nan=True)


def test_grid_of_stretches_equals_a_grid_of_whole_series(spark, monkeypatch):
    """Series of more stretches than one and of different lengths, in tasks that remember one permutation or many."""
    rng = np.random.default_rng(8)
    rows = [("7|a", t, float(v)) for t, v in enumerate(rng.integers(0, 9, 5000))] + [("7|b", t, float(v)) for t, v in enumerate(rng.normal(size=4500))] + [("8|a", t, float(v)) for t, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "series_id string, t long, x double")
    jobs = {"7|a": [("acf_max", {}, 5)], "7|b": [("mi_max", {}, 4), ("fft_peak", {}, 3)], "8|a": [("acf_max", {}, 6)]}
    seeds = {"7|a": 7, "7|b": 7, "8|a": 8}
    for null in ("shuffle", "aaft"):
        want = {(r.series_id, r.test): (r.k_sur, r.stat, r.sur_mean) for r in evaluation.grid(statistics.packed(df, ["series_id"]), jobs, null=null, seeds=seeds, parts=1).collect()}
        monkeypatch.setattr(evaluation, "REMEMBERED", 1)
        got = {(r.series_id, r.test): (r.k_sur, r.stat, r.sur_mean) for r in evaluation.grid(df, jobs, null=null, seeds=seeds).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want) and {k: v[0] for k, v in got.items()} == {("7|a", "acf_max"): 5, ("7|b", "mi_max"): 4, ("7|b", "fft_peak"): 3, ("8|a", "acf_max"): 6}


def test_a_twin_table_is_small_and_walked_as_before(spark):
    x = np.random.default_rng(2).integers(0, 9, 400).astype(float)
    table = neighbours.twin_table(x)
    assert table.dtype == np.int32
    rng = np.random.default_rng(3)
    at, anew, picks = int(rng.integers(len(table))), rng.integers(0, len(table), 400), rng.integers(0, 10, 400)
    want = []
    for again, pick in zip(anew, picks):
        want.append(x[at])
        at = int(table[at, pick]) + 1
        at = int(again) if at >= len(table) else at
    assert list(resampling.twin_surrogate(x, np.random.default_rng(3), table=table)) == want


def test_transforms_leave_their_series_as_it_is():
    for n in (2 * 10007, 10007, 4 * 2503, 2 * 3 * 11 * 101):
        x = np.random.default_rng(n).integers(0, 50, n).astype(float)
        held = x.copy()
        held.flags.writeable = False  # as those that Arrow hands over
        assert np.allclose(transforms.rfft(held), np.fft.rfft(x), atol=1e-7) and np.array_equal(held, x)
        assert np.allclose(transforms.irfft(np.fft.rfft(x), n), x, atol=1e-9)
        order = np.random.default_rng(1).permutation(n)
        assert np.array_equal(np.sort(resampling.iterated_surrogate(held, order, 2)), np.sort(x)) and np.array_equal(held, x)


def test_tests_look_at_the_whole_series(spark):
    """What lies behind the first points counts: order that begins late is seen, by every test and by the distributed form."""
    x = np.concatenate([np.random.default_rng(4).normal(size=2500), np.arange(700.0)])
    assert statistics.np_perm_entropy(x) < statistics.np_perm_entropy(x, sub=2000) - 0.05
    rows = spark.createDataFrame([(t, float(v)) for t, v in enumerate(x)], "t long, x double")
    assert statistics.perm_entropy(rows, []).first().stat == pytest.approx(statistics.np_perm_entropy(x), abs=1e-9)
    assert statistics.perm_entropy(rows, [], sub=2000).first().stat == pytest.approx(statistics.np_perm_entropy(x, sub=2000), abs=1e-9)
    for name in ("approx_entropy", "sample_entropy", "multiscale_se", "rq_determinism", "corr_dim_slope"):
        fn = statistics.TESTS[name][0]
        assert abs(fn(x) - fn(x, sub=1200)) > 1e-6, name


def test_bits_count_windows_as_all_pairs_do(monkeypatch):
    monkeypatch.setattr(statistics, "BITS", 64)
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=333), rng.integers(0, 5, 300) * 0.1, np.full(70, 3.3), rng.integers(40, 170, 129) / 6):
        for r in (0.1, 0.2 * x.std() + 1e-12):
            for m, got in zip((1, 2, 3, 4), statistics._near(x, (1, 2, 3, 4), r)):
                w = np.lib.stride_tricks.sliding_window_view(x, m)
                assert got.tolist() == [int((np.abs(w - v).max(1) <= r).sum()) for v in w]


def test_gaps_are_filled_without_windows_to_the_end(spark):
    """Such a window is computed anew for every row: the square of a stretch."""
    x = [None if i % 7 in (2, 3) or i < 3 else float(i * i % 101) for i in range(9000)]
    rows = series.inpaint(spark.createDataFrame(list(enumerate(x)), "t long, x double"))
    assert "unboundedfollowing" not in rows._jdf.queryExecution().toString().lower().replace(" ", "")
    known = [i for i, v in enumerate(x) if v is not None]
    want = np.interp(np.arange(9000), known, [x[i] for i in known])
    assert [r.x for r in rows.orderBy("t").collect()] == pytest.approx(want.tolist(), abs=1e-9)


def test_controls_are_made_once(spark, monkeypatch):
    made = []
    for name in ("random_draws", "subset_marginal"):
        monkeypatch.setattr(resampling, name, lambda *a, name=name, plain=getattr(resampling, name): made.append(name) or plain(*a))
    d = resampling.random_draws(spark, 120, 2)
    made.clear()
    own = {"sig": "comp", "test": "acf_max", "params": {"_comp": {"op": "+", "a": "red_sum", "b": "blue"}, "_test": {"maxlag": 5}}}
    assert scans.axis_scan(d, [("g", "red_sum", ("acf_max",))], evolved=[own], k=20, k_control=20).count() == 2
    assert sorted(made) == ["random_draws", "subset_marginal", "subset_marginal"]
