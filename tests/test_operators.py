"""Controls: known structure is found, noise is not claimed; and operators against plain versions."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqsieve.functions import formula, signals
from seqsieve.operators import evaluation, forecast, gates, governance, resampling, scans, search, series, statistics
from seqsieve.sources import draws as draw_source
from seqsieve.sources import logs
from seqsieve.streaming import jobs


def frame(spark, **named):
    rows = [(name, t, float(v)) for name, x in named.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t long, x double")


def noise(n=600, seed=0):
    return np.random.default_rng(seed).normal(size=n)


def periodic(n=600):
    return np.sin(2 * np.pi * 7 * np.arange(n) / n) + 0.05 * noise(n, 1)


def blocks(n=600):
    return np.tile(np.arange(8.0), n // 8 + 1)[:n] + 0.01 * noise(n, 2)


def fair(spark, n=400, seed=3):
    return resampling.random_draws(spark, n, seed)


@pytest.mark.parametrize("test,series_of", [("fft_peak", periodic), ("acf_max", periodic), ("dfa_alpha", periodic), ("mi_max", periodic), ("rq_determinism", periodic), ("perm_entropy", blocks), ("approx_entropy", blocks), ("sample_entropy", blocks), ("multiscale_se", blocks)])
def test_power_of_every_univariate_test(spark, test, series_of):
    rows = frame(spark, structure=series_of())
    assert evaluation.evaluate(rows, [test], k=39, seed=1).first().p_raw < 0.05


def test_corr_dim_tells_structure_from_noise():
    assert statistics.np_corr_dim_slope(blocks(400)) < statistics.np_corr_dim_slope(noise(400))


@pytest.mark.parametrize("test", ["transfer_entropy", "granger", "ccm"])
def test_power_of_paired_tests(spark, test):
    x = noise(500, 4)
    y = 0.7 * np.concatenate(([0], x[:-1])) + 0.3 * noise(500, 5)
    rows = spark.createDataFrame(pd.DataFrame({"series_id": "pair", "t": range(500), "x": x, "y": y}))
    assert evaluation.evaluate_pair(rows, test, k=39, seed=2).first().p_raw < 0.05


def test_p_values_of_noise_are_spread(spark):
    rows = frame(spark, **{f"n{i}": noise(200, 10 + i) for i in range(30)})
    p = [r.p_raw for r in evaluation.evaluate(rows, ["acf_max"], k=19, seed=3, knobs={"acf_max": {"maxlag": 5}}).collect()]
    assert len(p) == 30 and 0.3 < np.mean(p) < 0.7


def test_distributed_and_packed_forms_agree(spark):
    rows = frame(spark, a=noise(300, 6), b=periodic(300))
    packed = statistics.packed(rows, ["series_id"])
    for name, form in (("acf_max", statistics.acf_max), ("perm_entropy", statistics.perm_entropy), ("mi_max", statistics.mi_max)):
        one = {r.series_id: r.stat for r in form(rows, ["series_id"]).collect()}
        two = {r.series_id: r.stat for r in statistics.measure(packed, name, ["series_id"]).collect()}
        assert one == pytest.approx(two, abs=1e-9)


def test_results_do_not_depend_on_partitions(spark):
    rows = frame(spark, a=noise(300, 6), b=noise(300, 7))
    one, many = (evaluation.evaluate(rows.repartition(n), ["acf_max"], k=9, null=null, seed=5).select("sig", "p_raw", "sur_mean").orderBy("sig").collect() for null in ("shuffle",) for n in (1, 8))
    assert one == many


@pytest.mark.parametrize("kind", ["shuffle", "aaft", "iaaft"])
def test_surrogates_keep_values(spark, kind):
    x = periodic(200)
    packed = statistics.packed(frame(spark, s=x), ["series_id"])
    for r in resampling.surrogate_series(packed, kind, 3, 1).collect():
        assert np.allclose(sorted(r.x), sorted(x))
    if kind == "aaft":
        assert np.argmax(np.abs(np.fft.rfft(r.x))[1:]) == np.argmax(np.abs(np.fft.rfft(x))[1:])


def test_twin_surrogate_is_made_of_states():
    x = blocks(200)
    y = resampling.twin_surrogate(x, np.random.default_rng(0))
    assert len(y) == len(x) and set(y) <= set(x)


def test_marginal_null_breaks_pairs_and_shuffle_keeps_them(spark):
    rng = np.random.default_rng(1)
    rows = [(t, sorted([*map(int, rng.choice(np.arange(1, 17), 3, False)), *map(int, rng.choice(np.arange(18, 34), 3, False))]), int(rng.integers(1, 17))) for t in range(300)]
    d = spark.createDataFrame(rows, "t long, reds array<int>, blue int")
    balanced = F.avg((F.size(F.filter("reds", lambda x: x <= 16)) == 3).cast("int"))
    assert resampling.subset_marginal(d, 1, 2).agg(balanced).first()[0] < 0.6
    assert resampling.shuffled(d, 1, 2).agg(balanced).first()[0] == 1.0
    made = resampling.subset_marginal(d, 1, 2).collect()
    assert all(len(set(r.reds)) == 6 and 1 <= r.blue <= 16 for r in made)


def test_verdicts(spark):
    n = 2000
    whole = noise(n, 8) + 3 * np.sin(2 * np.pi * 17 * np.arange(n) / n)
    first = noise(n, 9) + 3 * np.sin(2 * np.pi * 17 * np.arange(n) / n) * (np.arange(n) < 0.7 * n)
    rows = frame(spark, whole=whole, first=first, none=noise(n, 12))
    got = {r.sig: r.verdict for r in gates.confirm(rows, "acf_max", n, k=39, seed=1, knobs={"maxlag": 20}).collect()}
    assert got["whole"] == "SIGNAL" and got["first"] == "UNCONFIRMED" and got["none"] != "SIGNAL"


def test_positive_control(spark):
    rows = gates.positive_control(spark)
    assert gates.confirm(rows, "acf_max", 1200, k=39, seed=1, knobs={"maxlag": 10}).first().verdict == "SIGNAL"


def test_fisher_of_one_is_itself(spark):
    rows = spark.createDataFrame([("a", 0.037), ("b", 0.0), ("c", 0.2), ("c", 0.1)], "k string, p double")
    got = {r.k: r.p_comb for r in evaluation.fisher(rows, ["k"], "p").collect()}
    h = -math.log(0.02)
    assert got == pytest.approx({"a": 0.037, "b": 1.0, "c": math.exp(-h) * (1 + h)})


def test_erf(spark):
    xs = [-4.0, -1.0, 0.0, 0.3, 2.9, 3.1, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(evaluation.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-10)


def test_bh(spark):
    p = [0.001, 0.02, 0.02, 0.03, 0.5, 0.9]
    q = {}
    for i, v in enumerate(p):
        q.setdefault(v, min(min(1, p[j] * len(p) / (j + 1)) for j in range(max(k for k in range(len(p)) if p[k] == v), len(p))))
    got = evaluation.bh_fdr(spark.createDataFrame([(v,) for v in p], "p_raw double")).collect()
    assert all(r.q == pytest.approx(q[r.p_raw]) for r in got)


def test_running_and_inpaint_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(series, "STRETCH", 7)
    x = np.arange(40.0)
    rows = spark.createDataFrame([(t, None if t in (0, 1, 9, 10, 11, 12, 13, 14, 15, 39) else float("nan") if t == 20 else float(v)) for t, v in enumerate(x)], "t long, x double")
    got = [r.x for r in series.inpaint(rows).orderBy("t").collect()]
    assert got == pytest.approx([2.0, 2.0, *x[2:39], 38.0])
    total = [r.s for r in series.running(frame(spark, a=x).select("t", "x"), "x", "s").orderBy("t").collect()]
    assert total == pytest.approx(np.cumsum(x))
    assert [r.x for r in series.inpaint(spark.createDataFrame([(0, None), (1, None)], "t long, x double")).collect()] == [0.0, 0.0]


def test_formula_rules(spark):
    d = fair(spark, 50)
    with pytest.raises(ValueError):
        formula.build(d, {"op": "+", "a": "blue", "b": {"op": "+", "a": "blue", "b": {"op": "+", "a": "blue", "b": {"op": "abs", "a": "blue"}}}})
    assert formula.text({"op": "/", "a": "red_sum", "b": {"op": "lag", "a": "blue", "k": 3}}) == "(red_sum / lag(blue, 3))"
    assert formula.key("a", "b", {"z": 1, "a": 2}) == 'a|b|{"a": 2, "z": 1}'
    assert formula.evaluate(d, {"op": "/", "a": "blue", "b": "red_consecutive"}).where("x is null").count() == 0


def test_forecasts_look_only_back(spark):
    x = noise(60, 3)
    one = formula.forecasts(frame(spark, a=x).select("t", "x"), 3).where("t <= 30").orderBy("t").collect()
    changed = np.concatenate([x[:32], noise(28, 4)])
    two = formula.forecasts(frame(spark, a=changed).select("t", "x"), 3).where("t <= 30").orderBy("t").collect()
    assert one == two
    assert one[10].mean == np.sign(x[10] - x[:11].mean()) and one[10].osc == np.sign(x[10] - x[7])


def test_recurrence_is_an_artifact_shape(spark):
    got = signals.recurrence_mean(fair(spark, 60)).orderBy("t").collect()
    assert got[0].x == 60.0 and got[-1].x < 30


def test_artifact_control_marks_no_fair_signal(spark):
    got = {r.sig: r.artifact for r in scans.artifacts(fair(spark, 300), ["red_sum", "red_parity"], k=39, seed=11).collect()}
    assert set(got) == {"red_sum", "red_parity"}


def test_drift_is_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(500):
        reds = set(map(int, rng.choice(np.arange(1, 34), 6, False)))
        if t >= 300 and 7 not in reds:
            reds = {7, *sorted(reds)[:5]}
        rows.append((t, sorted(reds), int(rng.integers(1, 17))))
    d = spark.createDataFrame(rows, "t long, reds array<int>, blue int")
    got = {(r.colour, r.ball): r for r in scans.ball_drift_scan(d, k=99, seed=1).collect()}
    assert got["red", 7].p_drift == 0.01 and got["red", 7].q_drift <= 0.5
    y = np.array([7 in r[1] for r in rows], float)
    c = y - y.mean()
    assert got["red", 7].momentum == pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum())
    s = sum(np.sign(y[j] - y[i]) for i in range(500) for j in range(i + 1, 500))
    mk = {(r.colour, r.ball): r.mk_z for r in scans.mann_kendall(d).collect()}
    assert np.sign(mk["red", 7]) == np.sign(s) and mk["red", 7] > 5


def test_registration_is_written_once(spark):
    known = spark.createDataFrame([("1", "m", 3)], "issue string, method string, blue int")
    new = spark.createDataFrame([("1", "m", 9), ("2", "m", 4)], "issue string, method string, blue int")
    assert sorted(map(tuple, forecast.register(known, new).collect())) == [("1", "m", 3), ("2", "m", 4)]


def test_csv_html_and_appends(spark, tmp_path):
    d = fair(spark, 20).withColumn("issue", F.lpad(F.col("t").cast("string"), 5, "0"))
    draw_source.write_csv(d, str(tmp_path / "csv"))
    (tmp_path / "csv" / "bad.csv").write_text("issue,r1,r2,r3,r4,r5,r6,b\n00099,1,2,x,4,5,6,7\n00098,1,2,3,4,5,6,7\n")
    back = draw_source.read_csv(spark, str(tmp_path / "csv"))
    assert back.count() == 21 and back.where("issue = '00099'").isEmpty()
    html = "<table><tbody id=tdata>" + "".join(f"<tr><td>x</td><td>{i:05d}</td>" + "".join(f"<td><b>{j}</b></td>" for j in (1, 2, 3, 4, 5, 6, i % 16 + 1)) + "<td>y</td></tr>" for i in range(3)) + "<tr><td>x</td><td>no</td></tr></tbody></table>"
    rows = draw_source.html_draws(spark.createDataFrame([(html,)], "html string")).collect()
    assert [r.issue for r in rows] == ["00000", "00001", "00002"] and rows[0].reds == [1, 2, 3, 4, 5, 6]
    master = d.where("t < 10").select("issue", "blue")
    assert draw_source.append_newer(master, d.where("t >= 8").select("issue", "blue")).count() == 20
    assert draw_source.newer(master.limit(0), d.select("issue", "blue")).count() == 20


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"issue": "1", "blue": 2}\nnot json\n{"issue": "2", "blue": 3}\n')
    assert logs.read_jsonl(spark, str(tmp_path / "a.jsonl"), "issue string, blue int").where("issue is not null").count() == 2
    for i in range(2):
        (tmp_path / f"seed{i}.json").write_text(json.dumps({"meta": {"seed": i}, "candidates": [{"sig": "a", "test": "t", "params": "{}", "p_raw": 0.1, "z": 1.0, "tier": "light"}] * (i + 1)}))
    (tmp_path / "seed9.json").write_text("{broken")
    assert logs.read_candidates(spark, str(tmp_path / "seed*.json")).count() == 3


def test_stream_ingest_appends_once(spark, tmp_path):
    land, out, cp = (str(tmp_path / x) for x in ("land", "table", "cp"))
    d = fair(spark, 12).withColumn("issue", F.lpad(F.col("t").cast("string"), 5, "0"))
    draw_source.flat(d.where("t < 8")).coalesce(1).write.csv(land, header=True)
    jobs.ingest(jobs.draw_stream(spark, land), out, cp)
    draw_source.flat(d.where("t >= 5")).coalesce(1).write.mode("append").csv(land, header=True)
    jobs.ingest(jobs.draw_stream(spark, land), out, cp)
    got = spark.read.parquet(out)
    assert got.count() == 12 and got.select("issue").distinct().count() == 12


def test_search_is_repeatable_and_skips_the_tried(spark):
    rng = random.Random(3)
    for _ in range(200):
        g = search.mutate(search.random_genome(rng), rng)
        for name, v in g["params"]["_test"].items():
            low, high, step = search.KNOBS[g["test"]][name]
            assert low <= v <= high and isinstance(v, float) == isinstance(step, float)
        if g["sig"] == "comp":
            assert formula.depth_of(g["params"]["_comp"]) <= 2
            assert formula.depth_of(search.cross(g["params"]["_comp"], search.random_formula(rng), rng)) <= 3
    x = np.zeros(400)
    shocks = noise(400, 5)
    for t in range(400):
        x[t] = shocks[t] + (0.9 * x[t - 8] if t >= 8 else 0)
    reds = [sorted(int(min(33, max(1, round(16 + 3 * v + j)))) for j in range(-3, 3)) for v in x]
    d = spark.createDataFrame([(t, r, 1 + t % 16) for t, r in enumerate(reds)], "t long, reds array<int>, blue int").cache()
    evals, frontier = search.evolve(d, epochs=1, pop=4, seed=7, tests=["acf_max"], k_light=9)
    again, _ = search.evolve(d, epochs=1, pop=4, seed=7, tests=["acf_max"], k_light=9)
    assert [e["gkey"] for e in evals] == [e["gkey"] for e in again] and [e["p_raw"] for e in evals] == [e["p_raw"] for e in again]
    assert frontier.tried == {e["gkey"] for e in evals} and len(frontier.elites) <= 12
    best, top = search.tune(d, "red_sum", "acf_max", k=9, steps=1, anchors=3, seed=1)
    assert best["maxlag"] >= 8 and top > 3


def test_governance(spark):
    base = {"cycle_id": 1, "best_q": 0.5, "best_p": 0.3, "fdr_q": 0.05, "alert": False, "n_eval": 90, "wf_verdict": "NULL", "wf_n_confirm": 0, "max_abs_z": 3.0, "n_artifact": 0, "control_verified": True}
    cases = {"OK": {}, "REVIEW": {"best_q": 0.01, "best_p": 0.04}, "ALERT": {"max_abs_z": 1e9}}
    schema = "cycle_id int, best_q double, best_p double, fdr_q double, alert boolean, n_eval int, wf_verdict string, wf_n_confirm int, max_abs_z double, n_artifact int, control_verified boolean"
    for want, change in cases.items():
        state = spark.createDataFrame([tuple((base | change).values())], schema)
        assert governance.audit(state).first().verdict == want
    assert [r.label for r in governance.failure_labels(spark.createDataFrame([tuple(base.values())], schema)).collect()] == ["null_honest"]
    ops = spark.createDataFrame([(1, "absorb", ["ingest_fate"], ["sigmap_injection"], ["bh_fdr_q"], None), (2, "propose", ["ingest_fate"], None, ["train_auc"], None), (3, "absorb", None, ["elsewhere"], None, "backtest_fit")], "op_id int, kind string, input_sources array<string>, output_sinks array<string>, used_feedback array<string>, objective string")
    assert sorted(map(tuple, governance.learning_audit(ops).collect())) == [(1, 0, "OK"), (2, 1, "ALERT"), (3, 3, "ALERT")]
    texts = spark.createDataFrame([("proven beyond doubt",), ("maybe proven",), ("nothing",), (None,)], "x string")
    assert [r[0] for r in texts.select(governance.overclaims(F.col("x"), ["proven"], ["maybe"])).collect()] == ["OVERCLAIM", "HEDGED", "NONE", "NONE"]


def test_alert_rule(spark):
    rows = spark.createDataFrame([(0.01, 0.01, False, "NULL"), (0.01, 0.2, False, "NULL"), (None, None, None, "SIGNAL"), (0.9, 0.9, True, None)], "q double, p double, s boolean, v string")
    assert [r[0] for r in rows.select(gates.alert(*map(F.col, "qpsv"))).collect()] == [True, False, True, True]
