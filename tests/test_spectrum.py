"""Transforms and surrogates of long series, and sums of products, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqsieve.operators import evaluation, resampling, spectrum, statistics


def frame(spark, **series):
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t long, x double").repartition(5)


def noise(n, seed):
    return np.random.default_rng(seed).normal(size=n)


# Short ones, 10 * 10, 13 * 5, a prime, twice a prime and a power of two; a task holds 64 values.
LENGTHS = {"one": 1, "short": 60, "square": 100, "thirteen": 65, "prime": 997, "twice": 1006, "power": 1024}


@pytest.fixture(scope="module")
def some(spark):
    data = {k: noise(n, i) for i, (k, n) in enumerate(LENGTHS.items())}
    return data, frame(spark, **data)


def test_plans():
    assert spectrum.plan(64, 64) == (64, 1, 64) and spectrum.plan(100, 64) == (100, 10, 10) and spectrum.plan(997, 64) == (2048, 32, 64)
    for n in (1 << 22, 10**9, 2**31 - 1, 6 * (2**20 - 3)):
        m, a, b = spectrum.plan(n)
        assert a * b == m and max(a, b) <= spectrum.BLOCK and (m == n or m >= 2 * n - 1)
    with pytest.raises(ValueError):
        spectrum.plan(3027, 64)
    n = 2 * (2**31 - 1)
    t = np.array([0, 1, 12345, n - 1, n // 3, 2**31])
    assert spectrum._square(t, n).tolist() == [int(x) ** 2 % n for x in t]


def test_transform_and_back(some):
    data, rows = some
    made = spectrum.transform(spectrum.measured(rows, ["series_id"]), ["series_id"], block=64)
    got = made.toPandas()
    back = spectrum.transform(made, ["series_id"], inverse=True, block=64).toPandas()
    for name, x in data.items():
        one, two = (df[df.series_id == name].sort_values("t") for df in (got, back))
        assert one.t.tolist() == list(range(len(x))) == two.t.tolist() and set(one.n) == {len(x)}
        assert np.allclose(one.re + 1j * one.im, np.fft.fft(x), atol=1e-10)
        assert np.allclose(two.re, x, atol=1e-11) and np.allclose(two.im, 0, atol=1e-11)


def test_missing_places_are_zeros(spark):
    x = noise(997, 3)
    rows = spectrum.measured(frame(spark, a=x), ["series_id"]).where("t % 3 > 0 and t < 600")
    got = spectrum.transform(rows, ["series_id"], block=64).orderBy("t").toPandas()
    there = np.where((np.arange(997) % 3 > 0) & (np.arange(997) < 600), x, 0)
    assert np.allclose(got.re + 1j * got.im, np.fft.fft(there), atol=1e-10)


def test_peak(spark, some):
    data, rows = some
    got = {r.series_id: r.stat for r in spectrum.fft_peak(rows, ["series_id"], block=64).collect()}
    for name, x in data.items():
        assert got[name] is None if len(x) < 8 else got[name] == pytest.approx(statistics.np_fft_peak(x), abs=1e-12)
    flat = spectrum.fft_peak(frame(spark, a=np.ones(100)), ["series_id"], block=64).first()
    assert flat.stat is None
    assert spectrum.fft_peak(frame(spark, a=data["prime"]).drop("series_id"), [], block=64).first().stat == pytest.approx(got["prime"])
    assert spectrum.fft_peak(frame(spark), ["series_id"]).count() == 0


def test_peak_beyond_a_packed_series(spark):
    n = 2048 * 2049
    assert n > statistics.LONGEST
    wave = 0.1 * F.sin(2 * np.pi * ((17 * F.col("id")) % n) / n) + (F.xxhash64("id") % 1000) / 1000
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("t"), wave.alias("x"))
    stat = spectrum.fft_peak(rows, [], block=1 << 16).first().stat
    noise_part = (np.arange(-999, 1000) / 1000).var()  # of the hash's remainder
    assert stat == pytest.approx(0.005 / (0.005 + noise_part), rel=0.02)


def test_ranks(spark):
    x = np.random.default_rng(0).integers(0, 20, 500)
    rows = frame(spark, a=x, b=-x).withColumn("y", F.col("x"))
    for r in spectrum.ranked(rows, "y", ["series_id"]).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("r")).collect():
        values = x if r.series_id == "a" else -x
        assert [p.rank for p in r.r] == list(range(500)) and [p.t for p in r.r] == np.argsort(values, kind="stable").tolist()


@pytest.mark.parametrize("rounds", [0, 3])
def test_surrogates_equal_the_packed_form(spark, rounds):
    data = {"prime": noise(997, 1), "even": np.round(noise(300, 2), 1), "odd": noise(15, 4) + 5}
    got = spectrum.randomised(frame(spark, **data), 2, 7, ["series_id"], rounds=rounds, block=64).toPandas()
    for name, x in data.items():
        for sid in (0, 1):
            own = got[(got.series_id == name) & (got.sid == sid)].sort_values("t")
            want = resampling.iterated_surrogate(x, resampling.order_of(len(x), 7, sid), rounds) if rounds else resampling.phase_surrogate(x, resampling.turns(len(x), 7, sid))
            assert own.t.tolist() == list(range(len(x))) and np.allclose(own.x, want)


def test_evaluations_of_long_series_equal_those_of_packed_ones(spark):
    rows = frame(spark, a=noise(200, 6), b=np.sin(np.arange(200)))
    for test, null in (("fft_peak", "shuffle"), ("acf_max", "aaft"), ("fft_peak", "iaaft")):
        one, two = (sorted((r.sig, round(r.stat, 9), round(r.sur_mean, 9), r.p_raw) for r in out.collect()) for out in (evaluation.evaluate_long(rows, test, k=5, null=null, seed=2), evaluation.evaluate(rows, [test], k=5, null=null, seed=2)))
        assert one == two
    with pytest.raises(ValueError):
        evaluation.evaluate_long(rows, "acf_max", k=5, null="twin")


def pairs(spark, **made):
    rows = [(k, t, float(a), float(b)) for k, (x, y) in made.items() for t, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "series_id string, t long, x double, y double").repartition(5)


def test_granger(spark):
    x, e = noise(1200, 1), noise(1200, 2)
    driven = np.concatenate(([0], 0.7 * x[:-1])) + 0.3 * e
    slow = np.convolve(e, [1, 0.8, 0.5, 0.2], "full")[:1200] + 1e6
    made = {"driven": (x, driven), "back": (driven, x), "none": (x, slow), "short": (x[:20], e[:20]), "flat": (x, np.ones(1200)), "long": (noise(9000, 3), noise(9000, 4))}
    rows = pairs(spark, **made)
    for lag in (1, 3, 5):
        got = {r.series_id: r.stat for r in statistics.granger(rows, ["series_id"], max_lag=lag).collect()}
        for name, (a, b) in made.items():
            want = statistics.np_granger(a, b - b.mean(), max_lag=lag) if name != "flat" else np.nan
            assert got[name] is None if not np.isfinite(want) else got[name] == pytest.approx(want, rel=1e-6, abs=1e-9), (name, lag)
    one = statistics.granger(rows.where("series_id = 'driven'").drop("series_id"), []).first().stat
    assert one == pytest.approx(statistics.np_granger(*made["driven"]), rel=1e-6)
    p = {r.sig: r.p_raw for r in evaluation.evaluate_long(rows.where("series_id in ('driven', 'none')"), "granger", k=19, seed=1).collect()}
    assert p["driven"] == 0.05 and p["none"] > 0.05


def test_a_p_that_is_no_number_is_no_hypothesis(spark):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, float("nan")), (3, None)], "id int, p_raw double")
    assert {r.id: r.q for r in evaluation.bh_fdr(rows).collect()} == {0: 0.02, 1: 0.02, 2: None, 3: None}
