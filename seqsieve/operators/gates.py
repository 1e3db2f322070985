"""Gates on a candidate: out of sample, out of time, discovery and confirmation, alerts, controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.functions import formula, signals
from seqsieve.operators import evaluation, resampling, scans, series, statistics


def hit_rates(rows: DataFrame, n: int, *, learn: tuple[float, float], test: tuple[float, float], rules=("cont", "rev"), k: int = 2, least: int = 30, keys: list[str] = ()) -> DataFrame:
    """(keys, rule, learn_rate, hit_rate, tested): the rule with the best direction hits over t in learn (fractions of n)
    and its hits over t in test. Steps where the rule or the series says nothing do not count; fewer than `least` such
    steps give .5 when learning and null when testing."""
    f = formula.forecasts(rows, k, keys)
    between = lambda part: (F.col("t") >= int(part[0] * n)) & (F.col("t") < int(part[1] * n))
    cols = []
    for rule in rules:
        valid = (F.col(rule) != 0) & (F.col("actual") != 0)
        for name, part in (("learn", learn), ("test", test)):
            cols += [F.sum(F.when(valid & between(part), 1).otherwise(0)).alias(f"{rule}_{name}_n"), F.sum(F.when(valid & between(part) & (F.col(rule) == F.col("actual")), 1).otherwise(0)).alias(f"{rule}_{name}_k")]
    one = f.groupBy(*keys).agg(*cols)
    rate = lambda rule, part, other: F.when(F.col(f"{rule}_{part}_n") >= least, F.col(f"{rule}_{part}_k") / F.greatest(F.lit(1), F.col(f"{rule}_{part}_n"))).otherwise(other)
    each = F.array(*[F.struct(rate(r, "learn", F.lit(0.5)).alias("learn_rate"), F.lit(-i).alias("i"), F.lit(r).alias("rule"), rate(r, "test", F.lit(None)).alias("hit_rate"), F.col(f"{r}_test_n").alias("tested")) for i, r in enumerate(rules)])
    return one.select(*keys, F.array_max(each).alias("s")).select(*keys, "s.rule", "s.learn_rate", "s.hit_rate", "s.tested")


def out_of_sample(rows: DataFrame, n: int, frac: float = 0.2, rules=("cont", "rev"), keys: list[str] = ()) -> DataFrame:
    return hit_rates(rows, n, learn=(0.0, 1 - frac), test=(1 - frac, 1.0), rules=rules, keys=keys)


def out_of_time(rows: DataFrame, n: int, train: float = 0.85, blind: float = 0.91, rules=("cont", "rev"), keys: list[str] = ()) -> DataFrame:
    """The rule is frozen on the first part; the draws between train and blind are left out."""
    return hit_rates(rows, n, learn=(0.0, train), test=(blind, 1.0), rules=rules, keys=keys)


def hit_rate_p(rows: DataFrame, n: int, *, k: int = 40, seed: int = 0, gate=out_of_sample) -> DataFrame:
    """The gate's row with p: the share of shuffled series, each with its own best rule and its own signs, that do as well."""
    real = gate(rows, n)
    made = gate(resampling.shuffled(rows.select("t", "x"), k, seed), n, keys=["sid"])
    p = series.with_scalars(made.where("hit_rate is not null").select(F.col("hit_rate").alias("h")), real.select("hit_rate"))
    p = p.agg(F.coalesce(F.sum((F.col("h") >= F.col("hit_rate")).cast("int")), F.lit(0)).alias("as_good"), F.count(F.lit(1)).alias("k_sur"))
    return series.with_scalars(real, p).withColumn("p", F.least(F.lit(1.0), (F.col("as_good") + 0.5) / F.greatest(F.lit(1), F.col("k_sur"))))


def out_of_time_p(rows: DataFrame, n: int, *, k: int = 40, seed: int = 0, train: float = 0.85, blind: float = 0.91, rules=("cont", "rev"), old: int = 2, least: int = 30) -> DataFrame:
    """The out-of-time row with sur_mean, as_good, k_sur and p: the rule frozen on the real series is read on shuffled series,
    and what it says of each step is held to the real step."""
    real = out_of_time(rows, n, train, blind, rules)
    truth = formula.forecasts(rows, old).where(F.col("t") >= int(blind * n)).select("t", "actual")
    made = formula.forecasts(resampling.shuffled(rows.select("t", "x"), k, seed), old, ["sid"]).drop("actual").where(F.col("t") >= int(blind * n))
    said = F.element_at(F.create_map(*[c for r in rules for c in (F.lit(r), F.col(r))]), F.col("rule"))
    held = series.with_scalars(made.join(truth, "t"), real.select("rule", "hit_rate")).withColumn("said", said).where("said <> 0 and actual <> 0")
    rate = held.groupBy("sid").agg(F.avg((F.col("said") == F.col("actual")).cast("double")).alias("h"), F.count(F.lit(1)).alias("c"), F.max("hit_rate").alias("hit_rate")).where(F.col("c") >= least)
    p = rate.agg(F.avg("h").alias("sur_mean"), F.coalesce(F.sum((F.col("h") >= F.col("hit_rate")).cast("int")), F.lit(0)).alias("as_good"), F.count(F.lit(1)).alias("k_sur"))
    return series.with_scalars(real, p).withColumn("p", F.when(F.col("hit_rate").isNotNull() & (F.col("k_sur") > 0), F.least(F.lit(1.0), (F.col("as_good") + 0.5) / F.greatest(F.lit(1), F.col("k_sur")))))


def reevaluate(rows: DataFrame, n: int, tests: list[str], *, frac: float = 0.2, k: int = 25, seed: int = 0, knobs: dict | None = None) -> DataFrame:
    """Evaluation rows of the same tests on the last part of every series (series_id, t, x), heavy tests with half the
    surrogates (10 at least); no rows where that part has fewer than 60 draws."""
    cut = int(n * (1 - frac))
    tail = rows.where(F.col("t") >= (cut if n - cut >= 60 else n)).withColumn("t", F.col("t") - cut)
    many = {t: k if statistics.TESTS[t][2] == "light" else max(10, k // 2) for t in tests}
    return evaluation.evaluate(tail.select("series_id", "t", "x"), tests, k=many, seed=seed, knobs=knobs)


def parts(rows: DataFrame, n: int, n_folds: int = 3, discovery: float = 0.7) -> DataFrame:
    """rows(series_id, t, x) as the series of each fold's parts: (series_id, fold, part, t, x), t from 0 in each part.
    The few folds are a broadcast table; a row goes to the parts that hold it."""
    folds = rows.sparkSession.range(1).select(F.explode(evaluation.folds(F.lit(n), n_folds, discovery)).alias("f")).select("f.*")
    spans = folds.select("fold", F.explode(F.array(F.struct(F.lit("disc").alias("part"), F.lit(0).cast("long").alias("lo"), F.col("d_end").cast("long").alias("hi")), F.struct(F.lit("conf").alias("part"), F.col("c_start").cast("long").alias("lo"), F.col("c_end").cast("long").alias("hi")))).alias("s")).select("fold", "s.*")
    return rows.join(F.broadcast(spans), (F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi"))).select("series_id", "fold", "part", (F.col("t") - F.col("lo")).alias("t"), "x")


def confirm(rows: DataFrame, test: str, n: int, *, k: int = 60, seed: int = 0, n_folds: int = 3, discovery: float = 0.7, knobs: dict | None = None) -> DataFrame:
    """Verdict of every series (series_id, t, x): p of the frozen test on each fold's two parts, each against its own
    surrogates, of which heavy tests have a third (20 at least). The values of x must not look outside their own part (row-local signals and formulas do not)."""
    k = k if statistics.TESTS[test][2] == "light" else max(20, k // 3)
    split = parts(rows, n, n_folds, discovery).withColumn("series_id", F.concat_ws("#", "series_id", "fold", "part"))
    evals = evaluation.evaluate(split, [test], k=k, seed=seed, knobs={test: knobs or {}})
    bits = F.split("sig", "#")
    rows = evals.select(bits[0].alias("sig"), bits[1].alias("fold"), bits[2].alias("part"), "p_raw").groupBy("sig", "fold").agg(F.max(F.when(F.col("part") == "disc", F.col("p_raw"))).alias("disc_p"), F.max(F.when(F.col("part") == "conf", F.col("p_raw"))).alias("conf_p"))
    return evaluation.verdict(rows, ["sig"])


def alert(best_q, oos_p, spectral_alert, wf_verdict, alert_q: float = 0.05, alert_oos_p: float = 0.05):
    """Whether the best evaluation is worth a call."""
    return F.coalesce((best_q < alert_q) & (oos_p < alert_oos_p), F.lit(False)) | F.coalesce(spectral_alert, F.lit(False)) | F.coalesce(wf_verdict == "SIGNAL", F.lit(False))


def positive_control(spark, n: int = 1200, lag: int = 8, phi: float = 0.9, seed: int = 0) -> DataFrame:
    """(series_id, t, x): a known autoregressive structure, which every gate must let through."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    for t in range(lag, n):
        x[t] += phi * x[t - lag]
    return spark.createDataFrame(pd.DataFrame({"series_id": "control", "t": range(n), "x": x}))


def stability(history: DataFrame, order: str = "cycle", value: str = "best_q", last: int = 20) -> DataFrame:
    """(n, cv, iqr) of the last values of a history table: a top-k first."""
    recent = history.orderBy(F.col(order).desc()).limit(last)
    return recent.agg(F.count(value).alias("n"), (F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"))


def p_histogram(evals: DataFrame, p: str = "p_raw") -> DataFrame:
    """Counts by the edges 0, .01, .05, .1, .2, .5 and 1."""
    edges = (0.01, 0.05, 0.1, 0.2, 0.5)
    which = sum(((F.col(p) >= e).cast("int") for e in edges), F.lit(0))
    return evals.where(F.col(p).between(0, 1)).groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _genome(sig, test, params) -> dict | None:
    """The genome of a candidate, or None if this engine does not know its signal, test, formula or knobs."""
    import json

    from seqsieve.functions import formula
    from seqsieve.operators import search

    try:
        given = json.loads(params) if params else {}
        own = {"_sig": given.get("_sig") or {}, "_test": given.get("_test") or {}, "_reorder": given.get("_reorder") or "identity"}
        fits = set(own["_test"]) <= set(search.KNOBS.get(test, ())) and set(own["_sig"]) <= set(search.SIGNAL_KNOBS.get(sig, ())) and own["_reorder"] in search.REORDERS
        if sig == "comp":
            own["_comp"] = given["_comp"]
            fits = fits and formula.valid(own["_comp"])
        fits = fits and (sig == "comp" or sig in signals.SIGNALS or sig in signals.SERIES) and test in statistics.TESTS and test not in statistics.PAIRED
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return {"sig": sig, "test": test, "params": own} if fits else None


def ingest(draws: DataFrame, candidates: DataFrame, *, k: int = 40, k_control: int = 60, seed: int = 0, frontier=None) -> DataFrame:
    """A fate row for each of candidates(sig, test[, params as JSON]): (sig, test, params, label, p_shuffle, ctrl_label, artifact,
    absorbed). A label first, of the candidate as it is, formula, knobs and order included, under its own test; only survivors are
    put to the control on fair random draws, and those that are none there are absorbed: a search.Frontier that is given gets
    their evaluations. An unknown signal, test, formula or knob is ERROR. Candidates of one submission are a short list, which
    comes to the driver."""
    from seqsieve.operators import search

    spark = draws.sparkSession
    params = F.col("params") if "params" in candidates.columns else F.lit(None).cast("string")
    asked = sorted({(r.sig, r.test, r.params) for r in candidates.select("sig", "test", params.alias("params")).distinct().collect() if r.sig is not None and r.test is not None}, key=repr)
    genomes = {a: _genome(*a) for a in asked}
    known = {search.key_of(g): g for g in genomes.values() if g is not None}
    label = {r.gkey: r for r in scans.label_genomes(draws, list(known.values()), k=k, seed=seed).collect()}
    alive = [known[key] for key, r in label.items() if r.label == "SURVIVOR"]
    artifact = {r.gkey: r.artifact for r in scans.genome_artifacts(draws, alive, k=k_control, seed=seed).collect()} if alive else {}
    absorbed = [g for g in alive if artifact.get(search.key_of(g)) is False]
    if frontier is not None and absorbed:
        frontier.update(search.evaluate_genomes(draws, absorbed, k_light=k, k_heavy=k, seed=seed))
    rows = []
    for (sig, test, params), g in genomes.items():
        r = label.get(search.key_of(g)) if g is not None else None
        made = artifact.get(search.key_of(g)) if g is not None else None
        rows.append((sig, test, params, r.label if r else "ERROR", r.p_shuffle if r else None, None if made is None else "SURVIVOR" if made else "NOT_SURVIVOR", made, made is False))
    return spark.createDataFrame(rows, "sig string, test string, params string, label string, p_shuffle double, ctrl_label string, artifact boolean, absorbed boolean")


def model_card(verdicts: DataFrame, n_folds: int = 3, control: bool | None = None) -> DataFrame:
    """Verdict rows (sig, disc_combined_p, conf_combined_p, n_confirm, verdict) as reports: what was found, and what it may be
    taken for."""
    note = F.when(F.col("verdict") == "SIGNAL", "structure that held up in parts not searched; review by a person is due").when(F.col("verdict") == "UNCONFIRMED", "seen in discovery only: overfitting, stopped here").otherwise("nothing beyond chance in either part")
    return verdicts.select("sig", F.lit(n_folds).alias("n_folds"), F.col("disc_combined_p").alias("discovery_combined_p"), F.col("conf_combined_p").alias("confirmation_combined_p"), F.col("n_confirm").alias("n_folds_confirmed"), "verdict", F.lit(control).cast("boolean").alias("positive_control_passed"), note.alias("note"))


def digest(history: DataFrame, last: int = 24, order: str = "cycle_id") -> DataFrame:
    """One row over the last cycles of history(cycle_id, alert, best_q, artifact_prone array): how many alerts, which signals made
    their own structure, and the newest cycle's best q."""
    recent = history.orderBy(F.col(order).desc()).limit(last)
    prone = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("artifact_prone", F.array().cast("array<string>"))))))  # of `last` rows
    return recent.agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last_cycle"), F.max_by("best_q", order).alias("best_q"), F.coalesce(F.sum(F.coalesce(F.col("alert"), F.lit(False)).cast("int")), F.lit(0)).alias("alerts"), F.array_join(prone, ",").alias("artifacts"))
