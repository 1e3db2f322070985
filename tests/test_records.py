"""The audit ledger, the shared table of evaluations, and gates that must be able to speak."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqsieve.functions import signals
from seqsieve.operators import evaluation, forecast, gates, governance, ledger, proposals, resampling, scans, search
from seqsieve.sources import logs
from seqsieve.sources.evaluations import KEYS, Evaluations


def entries(spark, names, **more):
    kinds = "o long, gkey string, " + ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in more.items())
    return spark.createDataFrame([(i, n, *more.values()) for i, n in enumerate(names)], kinds).repartition(3)


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger"))
    was, ledger.BLOCK = ledger.BLOCK, 7
    try:
        assert ledger.append(entries(spark, [f"g{i}" for i in range(20)], kind="candidate", passed=True), path, "o") == 3
        assert ledger.append(entries(spark, ["g1", "g2", "g3", None], kind="verdict", verdict="SIGNAL"), path, "o") == 1
        assert ledger.append(entries(spark, [], kind="verdict", verdict="SIGNAL"), path, "o") == 0
        assert ledger.append(entries(spark, ["g3"], kind="verdict", verdict="NULL"), path, "o") == 1
    finally:
        ledger.BLOCK = was
    rows, blocks = ledger.read(spark, path)
    return rows.cache(), blocks.cache()


def whys(rows, blocks):
    return {r.seq: r.why for r in ledger.verify(rows, blocks).collect() if r.why is not None}


def test_a_whole_ledger_verifies(book):
    rows, blocks = book
    assert [r.seq for r in rows.orderBy("seq").collect()] == list(range(25)) and blocks.count() == 5
    assert [r.gkey for r in rows.orderBy("seq").limit(20).collect()] == [f"g{i}" for i in range(20)]
    assert whys(rows, blocks) == {}


def test_every_tampering_is_found(spark, book):
    rows, blocks = book
    assert whys(rows.withColumn("passed", F.when(F.col("seq") != 8, F.col("passed"))), blocks) == {8: "content"}
    reset = rows.withColumn("gkey", F.when(F.col("seq") == 8, "other").otherwise(F.col("gkey")))
    reset = reset.withColumn("row_hash", ledger.row_hash())  # the hash was made anew, too
    assert whys(reset, blocks) == {i: "block" for i in range(7, 14)}
    assert whys(rows.where("seq <> 8"), blocks) == {i: "block" for i in range(7, 14) if i != 8}
    assert whys(rows.unionByName(rows.where("seq = 8")), blocks).keys() == set(range(7, 14))
    sealed = ledger.digests(reset).select("block", "first", "n", "digest").join(blocks.select("block", "prev"), "block").withColumn("hash", ledger.block_hash())
    assert whys(reset, sealed) == {i: "link" for i in range(14, 20)}  # the block after it still names the old hash
    assert whys(rows, blocks.where("block < 4")) == {24: "unsealed"}
    assert whys(rows.where("block <> 1"), blocks.where("block <> 1")) == {i: "link" for i in range(14, 20)}
    assert ledger.verify(*ledger.read(spark, "/tmp/no/such/ledger")).count() == 0


def test_promotion_takes_all_of_control_verdict_signature_and_ledger(spark, book):
    rows, blocks = book
    signed = spark.createDataFrame([("g1", "a person"), ("g1", "another"), ("g2", None), ("g3", "a person"), ("g9", "a person"), (None, "x")], "gkey string, signed_by string")
    assert [tuple(r) for r in ledger.promotable(rows, blocks, signed).collect()] == [("g1", "a person")]
    changed = rows.withColumn("source", F.when(F.col("seq") == 1, "elsewhere").otherwise(F.col("source")))
    assert ledger.promotable(changed, blocks, signed).count() == 0


def test_admission_by_random_draws(spark):
    d = resampling.random_draws(spark, 260, 3)
    asked = spark.createDataFrame([("a", "red_sum", "acf_max"), ("b", "red_recurrence_mean", "acf_max"), ("c", "red_sum", "none")], "gkey string, sig string, test string")
    got = {r.gkey: (r.label, r.passed) for r in ledger.admitted(d, asked, k=39, seed=1).collect()}
    assert got["a"] == ("NOT_SURVIVOR", True) and got["c"] == ("ERROR", False) and got["b"][0] in ("SURVIVOR", "NOT_SURVIVOR")


# Evaluations


def keyed(spark, names, value):
    return spark.createDataFrame([(n, "f", 40, 20, "shuffle", None if n == "none" else 0, value) for n in names], ", ".join(f"{c} {'long' if c in ('k_light', 'k_heavy', 'seed') else 'string'}" for c in (*KEYS, "value")))


def test_the_last_write_wins(spark, tmp_path):
    table = Evaluations(spark, str(tmp_path / "evals"))
    asked = keyed(spark, ["a", "b", "c", "none"], "").drop("value")
    hits, misses = table.answers(asked)
    assert hits.count() == 0 and misses.count() == 4 and table.compact() == 0
    one, two = Evaluations(spark, str(tmp_path / "evals")), Evaluations(spark, str(tmp_path / "evals"))
    one.append(keyed(spark, ["a", "b", "none"], "1"))
    two.append(keyed(spark, ["b", "d"], "2"))
    for _ in range(2):
        hits, misses = table.answers(asked)
        assert {r.gkey: r.value for r in hits.collect()} == {"a": "1", "b": "2", "none": "1"} and [r.gkey for r in misses.collect()] == ["c"]
        assert table.compact() > 0
    assert table.read().count() == 4


def test_a_search_goes_on_from_the_table(spark, tmp_path, monkeypatch):
    d = resampling.random_draws(spark, 120, 5).cache()
    table, options = Evaluations(spark, str(tmp_path / "evals")), {"epochs": 2, "pop": 3, "seed": 3, "tests": ["acf_max"], "k_light": 9, "fingerprint": "f"}
    first, _ = search.evolve(d, store=table, **options)
    plain, _ = search.evolve(d, **options)
    kept = lambda evals: sorted((e["gkey"], e["p_raw"], round(e["stat"], 12)) for e in evals)
    assert kept(first) == kept(plain) and table.read().count() == len(first)
    asked = []
    was = search.evaluate_islands
    monkeypatch.setattr(search, "evaluate_islands", lambda draws, islands, **o: asked.append(islands) or was(draws, islands, **o))
    again, _ = search.evolve(d, store=table, **options)
    assert kept(again) == kept(first) and asked == []


def test_seeds_together_equal_seeds_alone(spark, monkeypatch):
    d = resampling.random_draws(spark, 120, 5).cache()
    options = {"epochs": 2, "pop": 4, "tests": ["acf_max", "perm_entropy", "transfer_entropy"], "k_light": 9, "k_heavy": 5}
    jobs = []
    was = search.evaluate_islands
    monkeypatch.setattr(search, "evaluate_islands", lambda draws, islands, **o: jobs.append(set(islands)) or was(draws, islands, **o))
    found, frontiers = search.evolve_seeds(d, [1, 2, 7], **options)
    assert jobs == [{1, 2, 7}] * 2
    kept = lambda evals: sorted((e["gkey"], e["p_raw"], round(e["stat"], 12), round(e["sur_mean"], 12)) for e in evals)
    for seed in (1, 2, 7):
        alone, frontier = search.evolve(d, seed=seed, **options)
        assert kept(found[seed]) == kept(alone) and frontiers[seed].tried == frontier.tried and frontiers[seed].best_z == frontier.best_z
    sent = search.seed_candidates(spark, found, below=2.0)
    merged = logs.merged(sent).collect()
    assert sent.count() == sum(map(len, found.values())) and sum(r.seeds for r in merged) == sent.count()


def test_templates_are_tuned_together(spark, monkeypatch):
    d = resampling.random_draws(spark, 150, 6).cache()
    options = {"k": 9, "steps": 2, "anchors": 3, "seed": 4}
    jobs = []
    was = search.evaluate_genomes
    monkeypatch.setattr(search, "evaluate_genomes", lambda draws, genomes, **o: jobs.append(len(genomes)) or was(draws, genomes, **o))
    records = search.diff_search(d, **options)
    assert len(jobs) <= 1 + 2 + 2 + 1  # the middle, two knobs' anchors at most, the steps, the last measure
    assert [(r["sig"], r["test"]) for r in records] == list(search.POOL)
    for r in records[:2] + records[6:7]:
        assert search.tune(d, r["sig"], r["test"], comp=r["params"].get("_comp"), **options) == (r["params"]["_test"], pytest.approx(r["z"]))


# Gates


def test_few_surrogates_are_an_error(spark):
    d = resampling.random_draws(spark, 60, 1)
    for ask in (lambda: scans.rolling_verdict(d, 60, k=19), lambda: forecast.walk_forward(d, k=19), lambda: scans.label_axes(d, ["red_sum"], k=19), lambda: scans.cross_null(signals.long(d, ["red_sum"]), ["acf_max"], k=10)):
        with pytest.raises(ValueError):
            ask()
    evaluation.can_reach(20, 0.05)


def test_a_drift_is_seen_in_windows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(300):
        reds = sorted(map(int, rng.choice(np.arange(1, 18) if t % 100 < 50 else np.arange(17, 34), 6, False)))
        rows.append((t, reds, int(rng.integers(1, 17))))
    d = spark.createDataFrame(rows, "t long, reds array<int>, blue int")
    r = scans.rolling_verdict(d, 300, window=100, step=100, k=100, seed=1).first()
    assert (r.n_windows, r.n_sig_windows, r.verdict) == (3, 3, "LOCAL_STRUCTURE")
    fair = scans.rolling_verdict(resampling.random_draws(spark, 300, 4), 300, window=100, step=100, k=100, seed=1).first()
    assert fair.n_windows == 3 and fair.n_sig_windows < 3


def test_walk_forward_over_stretches(spark, monkeypatch):
    from seqsieve.operators import series

    rng = np.random.default_rng(7)
    rows = [(t, sorted(map(int, rng.choice(np.arange(1, 10) if t % 2 else np.arange(1, 34), 6, False))), 1) for t in range(700)]
    d = spark.createDataFrame(rows, "t long, reds array<int>, blue int").repartition(4)
    hits = 0
    for t in range(50, 699):
        weight = np.zeros(33)
        for a in range(1, 51):
            weight[np.array(rows[t - a][1]) - 1] += 0.99 ** (a - 1)
        hits += len(set(np.lexsort((np.arange(33), -np.round(weight, 9)))[:6] + 1) & set(rows[t][1]))
    for stretch in (4096, 64):
        monkeypatch.setattr(series, "STRETCH", stretch)
        r = forecast.walk_hits(d.select("t", "reds"), [], train_n=50).first()
        assert (r.n, r.hits) == (649, hits)
    monkeypatch.undo()
    r = forecast.walk_forward(d, train_n=50, k=39, seed=1).first()
    assert r.n == 649 and r.hit_rate == pytest.approx(hits / 649 / 6) and 0 < r.p_random <= 1
    # a ball's rule changes with time: its recent past tells the next draw, and shuffled order does not
    late = [(t, sorted(map(int, rng.choice(np.arange(1 + t // 100 * 6, 13 + t // 100 * 6) % 33 + 1, 6, False))), 1) for t in range(500)]
    told = forecast.walk_forward(spark.createDataFrame(late, "t long, reds array<int>, blue int"), train_n=50, k=39, seed=1).first()
    assert told.above_random and told.p_random == 1 / 40


def test_discovery_keeps_thirty(spark):
    for n, want in ((10, 1), (31, 1), (40, 10), (43, 30), (100, 70)):
        assert governance.discovery_part(spark.range(n).withColumnRenamed("id", "t")).count() == want


def test_gap_signals(spark):
    rng = np.random.default_rng(0)
    reds = [sorted(map(int, rng.choice(33, 6, False) + 1)) for _ in range(200)] + [[1, 6, 11, 16, 21, 26], [1, 2, 3, 4, 5, 6]]
    d = spark.createDataFrame([(t, r, 1) for t, r in enumerate(reds)], "t long, reds array<int>, blue int")
    for r, got in zip(reds, d.select("t", signals.column("red_gap_std").alias("s"), signals.column("lp_red_gap_skew").alias("k")).orderBy("t").collect()):
        g = np.diff(r).astype(float)
        assert got.s == pytest.approx(g.std(), abs=1e-9) and got.k == pytest.approx((((g - g.mean()) / (g.std() + 1e-9)) ** 3).mean(), abs=1e-6)


def test_candidates_come_in_as_they_are(spark, monkeypatch):
    """Knobs, formulas and orders reach the labels, what is unknown is an error, and survivors reach the frontier."""
    d = resampling.random_draws(spark, 200, 8).cache()
    comp = json.dumps({"_comp": {"op": "lag", "a": "red_sum", "k": 2}})
    bad = [("comp", "acf_max", None), ("comp", "acf_max", '{"_comp": {"op": "rm", "a": "blue"}}'), ("red_sum", "acf_max", '{"_test": {"unknown": 1}}'), ("red_sum", "ccm", None), ("x", "acf_max", None), ("red_sum", "acf_max", "{broken"), ("red_sum", "acf_max", '{"_reorder": "sideways"}')]
    good = [("red_sum", "acf_max", None), ("red_sum", "acf_max", '{"_test": {"maxlag": 5}}'), ("red_sum", "acf_max", '{"_reorder": "block"}'), ("comp", "acf_max", comp), ("vector_mag", "acf_max", '{"_sig": {"div": 31}}')]
    asked = spark.createDataFrame([*good, *bad, good[0], (None, "acf_max", None)], "sig string, test string, params string")
    frontier = search.Frontier()
    got = {(r.sig, r.test, r.params): r for r in gates.ingest(d, asked, k=20, k_control=20, seed=1, frontier=frontier).collect()}
    assert set(got) == {*good, *bad} and {a for a, r in got.items() if r.label == "ERROR"} == set(bad)
    assert len({got[a].p_shuffle for a in good}) > 1
    for a, r in got.items():
        assert r.absorbed == (r.label == "SURVIVOR" and r.artifact is False)
    was = scans.label_genomes
    monkeypatch.setattr(scans, "label_genomes", lambda *a, **o: was(*a, **o).withColumn("label", F.when(F.col("params").contains("31"), "SURVIVOR").otherwise("NULL")))
    monkeypatch.setattr(scans, "genome_artifacts", lambda draws, genomes, **o: spark.createDataFrame([(search.key_of(g), False) for g in genomes], "gkey string, artifact boolean"))
    got = {(r.sig, r.test, r.params): r.absorbed for r in gates.ingest(d, asked, k=20, k_control=20, seed=1, frontier=frontier).collect()}
    assert [a for a, v in got.items() if v] == [good[4]] and [e["sig"] for e in frontier.elites] == ["vector_mag"]


def test_an_evolved_formula_is_an_axis(spark):
    d = resampling.random_draws(spark, 150, 8).cache()
    own = {"sig": "comp", "test": "acf_max", "params": {"_comp": {"op": "+", "a": "red_sum", "b": "blue"}, "_test": {"maxlag": 5}}}
    got = {r.group: r for r in scans.axis_scan(d, [("g", "red_sum", ("acf_max",))], evolved=[own], k=20, k_control=20).collect()}
    assert set(got) == {"g", "evolved"} and got["evolved"].sig == search.key_of(own) and 0 < got["evolved"].p_shuffle <= 1


def test_sums_and_fills_in_three_levels(spark, monkeypatch):
    from seqsieve.operators import series

    monkeypatch.setattr(series, "STRETCH", 4)
    x = [None if t % 7 in (1, 2) or 20 <= t < 60 or t < 3 else float(t % 5) for t in range(100)]
    rows = spark.createDataFrame(list(enumerate(x)), "t long, x double").repartition(5)
    got = [r.x for r in series.inpaint(rows).orderBy("t").collect()]
    known = [t for t, v in enumerate(x) if v is not None]
    assert got == pytest.approx(np.interp(np.arange(100), known, [x[t] for t in known]).tolist())
    total = [r.s for r in series.running(rows.fillna(0), "x", "s").orderBy("t").collect()]
    assert total == pytest.approx(np.cumsum([v or 0 for v in x]).tolist())
    assert series.inpaint(rows.withColumn("x", F.lit(None).cast("double"))).agg(F.sum("x")).first()[0] == 0


def test_proposed_signals(spark, tmp_path, monkeypatch):
    """Sums that a logistic map leads: neither order nor spectrum explains that, and fair draws do not have it."""
    rng = np.random.default_rng(3)
    rows, x = [], 0.37
    for t in range(700):
        x = 3.99 * x * (1 - x)
        first = 1 + int(27.99 * x)
        rows.append((t, list(range(first, first + 6)), int(rng.integers(1, 17))))
    d = spark.createDataFrame(rows, "t long, reds array<int>, blue int").cache()
    own = {"p_sum": "aggregate(reds, 0D, (a, x) -> a + x)", "p_hash": "pmod(hash(reds, blue), 1000)", "p_bad": "nothing + 1", "p_many": "sum(blue)", "p_broken": "reds["}
    found = {r.name: r for r in proposals.try_out(d, own, k=40, k_control=40, seed=5).collect()}
    assert found["p_sum"].gate == "STAGED" and found["p_sum"].reason is None
    assert found["p_hash"].gate == "REJECTED" and {found[n].gate for n in ("p_bad", "p_many", "p_broken")} == {"ERROR"}
    assert not set(own) & set(signals.SIGNALS)
    with pytest.raises(ValueError):
        proposals.try_out(d, {"red_sum": "blue"}, k=40)
    told = proposals.try_out(d, {"p_sum": own["p_sum"]}, used=["zero_hypothesis_cross", "train_auc"], k=40, k_control=40, seed=5).first()
    assert told.gate == "REJECTED" and "train_auc" in told.reason
    path = str(tmp_path / "staged")
    assert proposals.waiting(spark, path).count() == 0
    for _ in range(2):
        proposals.stage(spark.createDataFrame(list(found.values())[:0] + [found["p_sum"], found["p_hash"]], "name string, expression string, label string, p_shuffle double, p_aaft double, p_marginal double, artifact boolean, gate string, reason string"), path)
    assert [(r.name, r.expression) for r in proposals.waiting(spark, path).collect()] == [("p_sum", own["p_sum"])]
    reviews = spark.createDataFrame([("p_sum", None)], "name string, confirmed boolean")
    assert proposals.waiting(spark, path, reviews).count() == 1 and proposals.waiting(spark, path, reviews.fillna(True)).count() == 0


def test_expressions_that_are_no_signals(spark):
    d = resampling.random_draws(spark, 20, 1)
    for text, fits in {"blue + 1": True, "reds[0] / 2": True, "count(1)": False, "row_number() over (order by blue)": False, "explode(reds)": False, "(select 1)": False, "x": False, "blue +": False, "'a'": True}.items():
        assert proposals.sound(d, text) == fits, text
