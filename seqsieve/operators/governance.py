"""What cycles learn from each other: failures, avoidance, novelty, audits, promotion. All over small tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The names of the failure labels below.
def failure_labels(state: DataFrame) -> DataFrame:
    """state(cycle_id, best_q, best_p, fdr_q, alert, n_eval, wf_verdict, wf_n_confirm, max_abs_z, n_artifact) to
    (cycle_id, label): what went wrong in a cycle, null_honest where nothing was claimed."""
    passed = F.coalesce(F.col("best_q") < F.col("fdr_q"), F.lit(False))
    rules = {
        "degenerate_stat": F.col("max_abs_z") > 1e6,
        "boundary_artifact": F.col("n_artifact") > 0,
        "single_fold_fragile": (F.col("wf_verdict") == "SIGNAL") & (F.col("wf_n_confirm") < 2),
        "multiplicity_noise": passed & (F.col("best_p") > 1 / (F.col("n_eval") + 1)),
        "null_honest": ~passed & ~F.coalesce("alert", F.lit(False)) & ~F.coalesce(F.col("wf_verdict") == "SIGNAL", F.lit(False)),
    }
    labels = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return state.select("cycle_id", F.explode(labels).alias("label"))


def avoidance_prior(labels: DataFrame, decay: float = 0.9) -> DataFrame:
    """(label, occurrences, avoid_weight, last_seen): 1 - decay^n; honest nulls are nothing to avoid."""
    out = labels.where("label <> 'null_honest'").groupBy("label").agg(F.count(F.lit(1)).alias("occurrences"), F.max("cycle_id").alias("last_seen"))
    return out.withColumn("avoid_weight", F.round(1 - F.pow(F.lit(decay), F.col("occurrences")), 4))


def debunked(prior: DataFrame, least: int = 3) -> DataFrame:
    return prior.where(F.col("occurrences") >= least).select("label")


def novelty_tilt(fate: DataFrame, column: str = "sig", debunked: DataFrame | None = None) -> DataFrame:
    """(column, n, tilt, elite_bias): the less a route was tried, the more it is favoured: min(2, 2 - share), from 1.05 on;
    elites of favoured routes are kept up to 1.5 times as readily, those of debunked ones a fifth."""
    n = fate.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    out = n.join(F.broadcast(total.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    out = out.withColumn("tilt", F.round(F.least(F.lit(2.0), 2 - F.col("n") / F.col("total")), 3))
    if debunked is not None:
        out = out.join(debunked.select(column, F.lit(True).alias("_gone")), column, "left")
    gone = F.coalesce(F.col("_gone"), F.lit(False)) if debunked is not None else F.lit(False)
    bias = F.when(gone, 0.2).when(F.col("tilt") > 1.05, F.round(F.least(F.lit(1.5), F.col("tilt")), 3)).otherwise(1.0)
    return out.select(column, "n", F.when(~gone & (F.col("tilt") > 1.05), F.col("tilt")).alias("tilt"), bias.alias("elite_bias"))


def audit(state: DataFrame) -> DataFrame:
    """(cycle_id, n_findings, verdict): ALERT for an absurd statistic or a failed positive control, REVIEW for a claim that
    noise or a missing confirmation explains, else OK."""
    passed = F.col("best_q").isNull() | (F.col("best_q") < F.col("fdr_q"))
    claims = F.coalesce(F.col("best_q") < F.col("fdr_q"), F.lit(False)) | F.coalesce("alert", F.lit(False))
    expected = 1 / (F.col("n_eval") + 1)
    chance = 1 - F.pow(1 - F.least(F.col("best_p"), F.lit(0.999)), F.col("n_eval"))
    noise = passed & (F.col("n_eval") > 0) & ((F.col("best_p") > expected) | (chance > 0.5))
    unheld = claims & (F.col("wf_verdict").isNull() | (F.col("wf_verdict") != "SIGNAL") | (F.col("wf_n_confirm") < 2))
    absurd, control = F.col("max_abs_z") > 1e6, F.col("control_verified") == F.lit(False)
    count = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    severe = count(absurd) + count(control)
    found = count(noise) + count(unheld) + severe
    return state.select("cycle_id", found.alias("n_findings"), F.when(severe > 0, "ALERT").when(found > 0, "REVIEW").otherwise("OK").alias("verdict"))


def overclaims(text: Column, risky: list[str], hedges: list[str]) -> Column:
    """NONE, HEDGED or OVERCLAIM: whether a text uses absolute words, and with or without a hedge."""
    low = F.lower(text)
    hit = lambda words: F.greatest(F.lit(False), *[low.contains(w.lower()) for w in words])
    return F.when(F.coalesce(~hit(risky), F.lit(True)), "NONE").when(hit(hedges), "HEDGED").otherwise("OVERCLAIM")


def discovery_part(draws: DataFrame, frac: float = 0.7) -> DataFrame:
    """What a search may see: the first part of the draws; of few draws, where that is below 30, all but the last 30, one at least."""
    n, cut = F.count(F.lit(1)), F.floor(F.count(F.lit(1)) * frac)
    n = draws.agg(F.when(cut < 30, F.greatest(F.lit(1), n - 30)).otherwise(cut).alias("_cut"))
    return draws.join(F.broadcast(n), F.col("t") < F.col("_cut")).drop("_cut")


def elites(evals: DataFrame, most: int = 12) -> DataFrame:
    """The most extreme evaluations in their tests' own directions, one for each key."""
    extreme = F.when(F.col("direction") == "high", F.col("z")).otherwise(-F.col("z"))
    return evals.withColumn("extremity", extreme).dropDuplicates(["gkey"]).orderBy(F.col("extremity").desc(), "gkey").limit(most)


def untried(genomes: DataFrame, tried: DataFrame) -> DataFrame:
    return genomes.join(tried.select("gkey").distinct(), "gkey", "left_anti")


def promote(candidates: DataFrame, signatures: DataFrame) -> DataFrame:
    """Candidates that a person has signed; nothing is promoted by the engine itself."""
    return candidates.join(signatures.where("signed_by is not null").select("gkey").distinct(), "gkey", "left_semi")


def formula_records(found: DataFrame) -> DataFrame:
    """found(sig, test, disc_p, wf_verdict) with gate and place: the walk-forward verdict if there is one, else UNCONFIRMED for a
    discovery p below .05, else NULL; places by gate, then by p, null last. A submission's records are a short list."""
    from pyspark.sql import Window

    gate = F.when(F.col("wf_verdict").isin("SIGNAL", "UNCONFIRMED"), F.col("wf_verdict")).when(F.coalesce(F.col("disc_p") < 0.05, F.lit(False)), "UNCONFIRMED").otherwise("NULL")
    rank = F.when(F.col("gate") == "SIGNAL", 0).when(F.col("gate") == "UNCONFIRMED", 1).otherwise(2)
    return found.withColumn("gate", gate).withColumn("place", F.row_number().over(Window.orderBy(rank, F.coalesce("disc_p", F.lit(1.0)), "sig", "test")))


def self_check(state: DataFrame, last: int = 5) -> DataFrame:
    """state(cycle_id, best_q, spectral_q, hit_rate, sur_mean, oos_p, oos_n, above_random, cross_consistent, oot_p, oot_hit, oot_n)
    to (cycle_id, score, warnings array): a cycle's results that a leak, a flaw or too little data would explain.

    Weights by rule: too perfect a hit rate out of sample or out of time 3, fewer than 30 steps 1, a best q more than .15 from the
    mean of the last cycles before (three at least) 1, structure that does not forecast 2, a spectral find the search missed 2."""
    from pyspark.sql import Window

    # A state table has a row for each cycle; ranks of cycles are taken over its key only.
    before = Window.orderBy("cycle_id").rowsBetween(-last, -1)
    rows = state.withColumn("_m", F.avg("best_q").over(before)).withColumn("_c", F.count("best_q").over(before))
    q, no = F.coalesce("best_q", F.lit(1.0)), F.lit(False)
    rules = {
        "oos_trivial": (3, (F.col("hit_rate") == 1.0) & (F.col("sur_mean") >= 0.99) & (F.col("oos_p") >= 0.95)),
        "oos_few": (1, F.col("oos_n") < 30),
        "oot_trivial": (3, (F.col("oot_hit") >= 0.99) & (F.col("oot_p") >= 0.95)),
        "oot_few": (1, F.col("oot_p").isNotNull() & F.col("oot_hit").isNotNull() & (F.coalesce("oot_n", F.lit(0)) < 30)),
        "best_q_drift": (1, (F.col("_c") >= 3) & (F.abs(q - F.col("_m")) > 0.15)),
        "structure_without_forecast": (2, (q < 0.05) & F.coalesce("cross_consistent", no) & F.col("above_random").isNotNull() & ~F.coalesce("above_random", no)),
        "search_missed": (2, (q >= 0.05) & (F.col("spectral_q") < 0.01)),
    }
    hit = {n: F.coalesce(c, no) for n, (_, c) in rules.items()}
    score = sum((F.when(hit[n], w).otherwise(0) for n, (w, _) in rules.items()), F.lit(0))
    warnings = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in hit.items()]), lambda x: x.isNotNull())
    return rows.select("cycle_id", score.alias("score"), warnings.alias("warnings"))


def diverse(evals: DataFrame, most: int = 12, each: int = 3) -> DataFrame:
    """evals(gkey, family, direction, z) to at most `most` rows, the most extreme in their tests' own directions, at most `each`
    of a family. A family keeps its first `each` before families meet."""
    from pyspark.sql import Window

    extreme = F.when(F.col("direction") == "high", F.col("z")).otherwise(-F.col("z"))
    rows = evals.withColumn("extremity", extreme).dropDuplicates(["gkey"])
    own = F.row_number().over(Window.partitionBy("family").orderBy(F.col("extremity").desc(), "gkey"))
    return rows.withColumn("place", own).where(F.col("place") <= each).orderBy(F.col("extremity").desc(), "gkey").limit(most)


def cached(asked: DataFrame, cache: DataFrame, keys=("gkey", "fingerprint", "k", "null_type", "seed")) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache that answer asked(keys), asked rows that it does not answer)."""
    keys = list(keys)
    return cache.join(asked.select(*keys).distinct(), keys, "left_semi"), asked.join(cache.select(*keys), keys, "left_anti")


def trend(history: DataFrame, last: int = 5, order: str = "cycle_id", value: str = "best_q") -> DataFrame:
    """(cycle, value, moving mean over the last cycles, change from the cycle before): what a trend chart shows. A row a cycle."""
    from pyspark.sql import Window

    along = Window.orderBy(order)
    moving = F.avg(value).over(along.rowsBetween(1 - last, 0))
    return history.select(order, value, moving.alias("moving"), (F.col(value) - F.lag(value).over(along)).alias("change"))


def kpi(history: DataFrame, order: str = "cycle_id") -> DataFrame:
    """One row of what matters about history(cycle_id, best_q, n_eval, alert, wf_verdict)."""
    n = F.count(F.lit(1))
    return history.agg(n.alias("cycles"), F.max_by("best_q", order).alias("last_q"), F.min("best_q").alias("least_q"), F.sum("n_eval").alias("evaluations"), F.coalesce(F.sum(F.coalesce(F.col("alert"), F.lit(False)).cast("int")), F.lit(0)).alias("alerts"), F.avg(F.coalesce(F.col("wf_verdict") == "SIGNAL", F.lit(False)).cast("double")).alias("signal_share"))


def leaderboard(evals: DataFrame, most: int = 20) -> DataFrame:
    """The best evaluations by q, then p, then key: a top-k."""
    return evals.orderBy(F.col("q").asc_nulls_last(), F.col("p_raw").asc_nulls_last(), "gkey").limit(most)


# Signals that learning may take as its aim, those it must not, where its input comes from and its output goes.
FEEDBACK = frozenset({"oot_blind_p", "bh_fdr_q", "random_control_label", "null_positive_control", "zero_hypothesis_cross", "wf_verdict"})
FORBIDDEN = frozenset({"in_sample_accuracy", "backtest_fit", "train_auc", "discovery_only_p", "any_discovery_only_metric"})
SOURCES = frozenset({"car1_gate_state", "car3_proposal_fate", "failure_taxonomy", "avoidance_prior", "ingest_fate"})
SINKS = frozenset({"sigmap_injection", "avoidance_prior_injection", "bias_corrector.json"})


def learning_audit(ops: DataFrame) -> DataFrame:
    """ops(op_id, kind, input_sources, output_sinks, used_feedback arrays, objective) to (op_id, n_findings, verdict): ALERT for an
    aim or a feedback that is forbidden, for no or unknown sources, and, where an operation writes, for no or unknown sinks."""
    known = lambda names: F.array(*[F.lit(n) for n in sorted(names)])
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    strange = lambda c, names: F.size(F.filter(listed(c), lambda x: ~F.array_contains(known(names), x)))
    writes = F.coalesce(F.col("kind").isin("absorb", "correct_bias"), F.lit(False))
    none = lambda c: (F.size(listed(c)) == 0).cast("int")
    bad = F.size(F.filter(listed("used_feedback"), lambda x: F.array_contains(known(FORBIDDEN), x)))
    aim = F.coalesce(F.col("objective").isin(*sorted(FORBIDDEN)), F.lit(False)).cast("int")
    found = none("input_sources") + strange("input_sources", SOURCES) + F.when(writes, none("output_sinks") + strange("output_sinks", SINKS)).otherwise(0) + bad + aim
    return ops.select("op_id", found.cast("int").alias("n_findings"), F.when(found > 0, "ALERT").otherwise("OK").alias("verdict"))


def needs_recheck(learned, confirmed_by_person):
    """Whether a signal must pass confirmation before use: learning made it, and no person has confirmed it."""
    return F.coalesce(learned, F.lit(False)) & ~F.coalesce(confirmed_by_person, F.lit(False))
