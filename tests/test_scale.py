"""Edges and levels of the distributed forms, and operators that carry state over."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqsieve.functions import signals
from seqsieve.operators import evaluation, forecast, gates, governance, resampling, scans, search, series, statistics
from seqsieve.sources import draws as draw_source
from seqsieve.streaming import jobs

from .test_operators import fair, frame, noise, periodic


def test_autocorr_keeps_series_of_one_point(spark):
    got = {r.series_id: r.stat for r in statistics.autocorr(frame(spark, a=[3.0], b=[1.0, 1.0], c=[1.0, 2.0, 4.0]), ["series_id"]).collect()}
    c = np.array([1.0, 2.0, 4.0]) - 7 / 3
    assert got == {"a": 0.0, "b": 0.0, "c": pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum())}


def test_fisher_of_many(spark):
    rows = spark.createDataFrame([("half", 0.5)] * 1500 + [("small", 1e-300)] * 40 + [("one", 1.0)] * 3, "k string, p double")
    got = {r.k: r.p_comb for r in evaluation.fisher(rows, ["k"], "p").collect()}
    h = 1500 * math.log(2)
    want, log = 0.0, -h
    for i in range(1500):
        want += math.exp(log)
        log += math.log(h) - math.log(i + 1)
    assert got == {"half": pytest.approx(want), "small": pytest.approx(0.0, abs=1e-200), "one": 1.0}


def test_bh_in_parts_equals_the_definition(spark):
    rng = np.random.default_rng(0)
    p = [*np.round(rng.uniform(size=300), 3).tolist(), *[0.01] * 40, *(rng.uniform(size=60) / 1e6).tolist()]
    rows = spark.createDataFrame([(k, v) for k in ("a", None) for v in (p if k else p[:50])] + [("a", None)], "k string, p_raw double")
    for k in ("a", None):
        own = sorted(p if k else p[:50])
        want = {}
        for j in range(len(own) - 1, -1, -1):
            last = max(i for i, v in enumerate(own) if v == own[j])
            want[own[j]] = min(1, own[j] * len(own) / (last + 1), want.get(own[last + 1], 1) if last + 1 < len(own) else 1)
        got = evaluation.bh_fdr(rows, keys=["k"], parts=7).where(F.col("k").eqNullSafe(F.lit(k)) & F.col("p_raw").isNotNull()).collect()
        assert len(got) == len(own) and all(r.q == pytest.approx(want[r.p_raw]) for r in got)
    assert evaluation.bh_fdr(rows, keys=["k"]).where("p_raw is null and q is null").count() == 1


def test_shifts_and_recurrence_over_stretches(spark, monkeypatch):
    d = fair(spark, 60).cache()
    want = [r.x for r in signals.recurrence_mean(d).orderBy("t").collect()]
    x = frame(spark, a=noise(60, 1), b=noise(45, 2))
    pairs = sorted(map(tuple, series.lagged_pairs(x, [1, 3], ["series_id"]).collect()))
    monkeypatch.setattr(series, "STRETCH", 7)
    assert [r.x for r in signals.recurrence_mean(d).orderBy("t").collect()] == want
    assert sorted(map(tuple, series.lagged_pairs(x, [1, 3], ["series_id"]).collect())) == pairs and len(pairs) == 59 + 44 + 57 + 42
    for lag in (-5, -1, 2, 6):
        for name, values in (("a", noise(60, 1)), ("b", noise(45, 2))):
            got = [r.y for r in series.shifted(x, lag, "x", "y", ["series_id"]).where(F.col("series_id") == name).orderBy("t").collect()]
            assert got == [values[t - lag] if 0 <= t - lag < len(values) else None for t in range(len(values))]
    gap = x.where("series_id = 'a' and t <> 9")
    assert series.shifted(gap, 1, "x", "y").where("t = 10").first().y is None
    with pytest.raises(ValueError):
        series.shifted(x, 7, "x", "y")


def test_dense_index_in_levels(spark):
    rng = np.random.default_rng(5)
    rows = [(int(d), int(k)) for d, k in zip(rng.integers(0, 4, 200), rng.permutation(200))]
    got = series.dense_index(spark.createDataFrame(rows, "d int, k int"), F.col("d"), ["d", "k"], within=F.floor(F.col("k") / 16)).orderBy("t").collect()
    assert [(r.d, r.k) for r in got] == sorted(rows) and [r.t for r in got] == list(range(200))


def test_long_series_are_refused_and_have_another_way(spark):
    x = frame(spark, a=noise(300, 6), b=periodic(300))
    with pytest.raises(Exception, match="distributed forms"):
        statistics.packed(x, ["series_id"], longest=299).collect()
    packed = {r.series_id: r.stat for r in statistics.measure(statistics.packed(x, ["series_id"], longest=300), "dfa_alpha", ["series_id"]).collect()}
    assert {r.series_id: r.stat for r in statistics.dfa_alpha(x, ["series_id"]).collect()} == pytest.approx(packed, abs=1e-9)
    assert statistics.dfa_alpha(frame(spark, a=noise(20)), ["series_id"]).first().stat is None
    for test, knobs in (("acf_max", {"maxlag": 4}), ("perm_entropy", {})):
        short = {r.sig: (r.stat, r.sur_mean, r.z, r.p_raw) for r in evaluation.evaluate(x, [test], k=9, seed=5, knobs={test: knobs}).collect()}
        long = {r.sig: (r.stat, r.sur_mean, r.z, r.p_raw) for r in evaluation.evaluate_long(x, test, k=9, seed=5, **knobs).collect()}
        assert set(short) == set(long) and all(short[s] == pytest.approx(long[s], rel=1e-6) for s in short)


def test_grid_serves_each_series_its_own_tests(spark):
    packed = statistics.packed(frame(spark, a=noise(200, 1), b=noise(200, 2), c=noise(200, 3)), ["series_id"])
    jobs_of = {"a": [("acf_max", {"maxlag": 3}, 5), ("acf_max", {"maxlag": 9}, 8)], None: [("fft_peak", {}, 4)]}
    one, two = ({(r.series_id, r.test, r.knobs): (r.k_sur, r.p_raw) for r in evaluation.grid(packed, jobs_of, seed=2, parts=p, bundles=b).collect()} for p, b in ((1, 1), (3, 5)))
    assert one == two and {k: v[0] for k, v in one.items()} == {("a", "acf_max", '{"maxlag": 3}'): 5, ("a", "acf_max", '{"maxlag": 9}'): 8, ("b", "fft_peak", "{}"): 4, ("c", "fft_peak", "{}"): 4}


def test_corr_dim_scales_by_the_whole_series():
    x = np.concatenate([noise(200, 1), 50 * noise(200, 2)])
    assert statistics.np_corr_dim_slope(x, sub=150) != statistics.np_corr_dim_slope(x[:150], sub=150)


def test_transfer_entropy_of_longer_pasts():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 1500).astype(float)
    y = np.concatenate(([0, 0], x[:-2]))
    one, two = (statistics.np_transfer_entropy(x, y, k_history=k, bins=2) for k in (1, 2))
    assert one < 0.05 and two > 0.9
    assert statistics.np_transfer_entropy(x, x[::-1].copy(), k_history=3, bins=4) >= 0


def test_axes_and_ingest(spark):
    d = fair(spark, 260).cache()
    got = {r.sig: r for r in scans.axis_scan(d, [("g", "red_sum", ("acf_max",)), ("g", "red_recurrence_mean", ("acf_max",))], k=20, k_control=20, seed=1).collect()}
    assert set(got) == {"red_sum", "red_recurrence_mean"} and all(r.label in ("NULL", "LINEAR_TIME_ARTIFACT", "SURVIVOR", "ARTIFACT_BY_CONSTRUCTION") for r in got.values())
    asked = spark.createDataFrame([("red_sum", "acf_max"), ("red_sum", "acf_max"), ("nothing", "acf_max"), (None, "x")], "sig string, test string")
    fate = {(r.sig, r.test): r for r in gates.ingest(d, asked, k=20, k_control=20, seed=1).collect()}
    assert set(fate) == {("red_sum", "acf_max"), ("nothing", "acf_max")} and fate["nothing", "acf_max"].label == "ERROR"
    assert all(r.absorbed == (r.label == "SURVIVOR" and not r.artifact) for r in fate.values())
    evals = spark.createDataFrame([("red_sum", 0.9), ("blue", 0.1)], "sig string, p_raw double")
    known = spark.createDataFrame([("red_parity",)], "sig string")
    assert {r.sig for r in scans.artifact_prone(d, evals, known, k=20).collect()} <= {"red_parity", "blue"}


def test_walk_forward_sees_a_hot_ball(spark):
    rng = np.random.default_rng(7)
    rows = [(t, sorted(map(int, rng.choice(np.arange(1, 10) if t % 2 else np.arange(1, 34), 6, False))), 1) for t in range(200)]
    d = spark.createDataFrame(rows, "t long, reds array<int>, blue int")
    r = forecast.walk_forward(d, train_n=50, k=20, seed=1).first()
    assert r.n == 149 and r.hit_rate > 0.3 and 0 < r.p_random <= 1
    assert forecast.walk_forward(d.where("t < 60"), train_n=50, k=20).first().n is None


def test_pick_accuracy_bounds(spark):
    r = forecast.pick_accuracy(fair(spark, 300), "red_sum", k=15, seed=2).first()
    assert r.k_sur == 15 and 0 < r.p <= 1 and r.hits == sum(forecast.pick_by_signal(fair(spark, 300), "red_sum").first()[c] for c in (2, 4))


def test_frontier_is_saved_and_resumed(spark, tmp_path):
    d = fair(spark, 120).select("t", "reds", "blue").cache()
    options = {"epochs": 1, "pop": 3, "seed": 5, "tests": ["acf_max", "transfer_entropy"], "k_light": 5, "k_heavy": 5}
    evals, frontier = search.evolve(d, fingerprint="f", **options)
    frontier.save(spark, str(tmp_path / "f"))
    back = search.Frontier.load(spark, str(tmp_path / "f"))
    assert (back.elites, back.tried, back.cache, back.best_z, back.coverage) == (frontier.elites, frontier.tried, frontier.cache, frontier.best_z, len(frontier.tried))
    assert search.Frontier.load(spark, str(tmp_path / "none")).coverage == 0
    more, later = search.evolve(d, fingerprint="f", frontier=back, **options)
    assert later.tried > frontier.tried and {e["gkey"] for e in more} - frontier.tried


def test_breeding_stays_within_depth(spark):
    rng = random.Random(1)
    elites = [search.random_formula(rng) for _ in range(3)]
    for _ in range(20):
        genomes, generation = search.breed(elites, rng, n=5)
        assert len(genomes) == 5 and 1 <= generation <= 2
        assert max(search.formula.depth_of(g["params"]["_comp"]) for g in genomes) == generation
        for g in genomes:
            search.mutate(g, rng, ["acf_max"])
    deep = search.nest(search.nest({"op": "+", "a": "blue", "b": "red_sum"}, rng), rng)
    assert search.formula.depth_of(deep) == 2
    kinds = {search.random_genome(rng)["params"]["_reorder"] for _ in range(200)}
    assert kinds == set(search.REORDERS)


def test_reordered_and_tuned_signals(spark):
    d = fair(spark, 90).select("t", "reds", "blue")
    genomes = [{"sig": "vector_mag", "test": "acf_max", "params": {"_sig": {"div": v}, "_test": {"maxlag": 5}, "_reorder": o}} for v in (30, 36) for o in search.REORDERS]
    found = search.evaluate_genomes(d, genomes, k_light=5)
    assert len(found) == 8 and len({round(e["stat"], 9) for e in found}) >= 6
    records = search.diff_search(d, candidates=2, k=4, steps=0, anchors=2, seed=1)
    assert [r["test"] for r in records] == ["acf_max", "mi_max"] and all(0 < r["disc_p"] <= 1 for r in records)


def test_streams_land_in_a_table(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00", 1.5) for i in range(9)], "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.windowed(stream(), "tumbling"), str(tmp_path / "out"), "complete")
    assert sorted(r.n for r in got.collect()) == [3, 3, 3]
    assert jobs.run_available(jobs.windowed(stream(), "tumbling"), str(tmp_path / "out"), "complete").count() == 3
    assert jobs.run_available(stream(), str(tmp_path / "rows")).count() == 9
    assert jobs.run_available(stream(), str(tmp_path / "rows")).count() == 9


def test_records(spark, tmp_path):
    state = spark.createDataFrame([(i, 0.5 if i < 5 else 0.01, 0.001, 1.0, 1.0, 0.99, 10, False, True, None, None, None) for i in range(6)], "cycle_id int, best_q double, spectral_q double, hit_rate double, sur_mean double, oos_p double, oos_n int, above_random boolean, cross_consistent boolean, oot_p double, oot_hit double, oot_n int")
    got = {r.cycle_id: (r.score, r.warnings) for r in governance.self_check(state).collect()}
    assert got[0] == (6, ["oos_trivial", "oos_few", "search_missed"]) and got[5] == (7, ["oos_trivial", "oos_few", "best_q_drift", "structure_without_forecast"])
    checks = spark.createDataFrame([(True, None), (True, True), (None, None)], "learned boolean, person boolean")
    assert [r[0] for r in checks.select(governance.needs_recheck(F.col("learned"), F.col("person"))).collect()] == [True, False, False]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("issue,r1,r2,r3,r4,r5,r6,b\n00003,1,2,3,4,5,6,7\n00002,1,2,3,4,5,x,7\n00001,1,2,3,4,5,6,8\n")
    draw_source.refresh(spark, str(tmp_path / "raw"), str(tmp_path / "clean"))
    assert [r.issue for r in draw_source.read_csv(spark, str(tmp_path / "clean"), strict=True).collect()] == ["00001", "00003"]
    assert signals.family("red_sum_mod7") == "other" and signals.family("comp", "blue") == "comp:blue"


def test_shuffles_agree_in_both_forms(spark):
    x = noise(500, 8)
    made = {(r.sid, r.t): r.x for r in resampling.shuffled(frame(spark, a=x).select("t", "x"), 3, 17).collect()}
    for sid in range(3):
        assert [made[sid, t] for t in range(500)] == x[resampling.order_of(500, 17, sid)].tolist()
