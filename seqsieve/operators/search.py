"""Search over genomes: the driver proposes, one DataFrame job an epoch evaluates all proposals.

A genome is {sig, test, params}; its key serves to skip what was tried, to look up cached results and to dedupe.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.functions import formula, signals
from seqsieve.operators import evaluation, series, statistics

# Ranges of the tests' and signals' knobs (low, high, step), floats kept as floats; ways to reorder draws.
KNOBS = {
    "fft_peak": {},
    "acf_max": {"maxlag": (5, 60, 1)},
    "dfa_alpha": {},
    "mi_max": {"maxlag": (2, 30, 1), "bins": (6, 20, 1)},
    "corr_dim_slope": {"m_max": (3, 9, 1), "tau": (1, 3, 1)},
    "perm_entropy": {"order": (2, 5, 1), "delay": (1, 3, 1)},
    "approx_entropy": {"m": (1, 3, 1), "r_factor": (0.10, 0.40, 0.05)},
    "rq_determinism": {"m": (2, 4, 1), "r_factor": (0.05, 0.30, 0.05)},
    "sample_entropy": {"m": (1, 3, 1), "r_factor": (0.10, 0.40, 0.05)},
    "multiscale_se": {"m": (1, 3, 1), "r_factor": (0.10, 0.40, 0.05), "tau_max": (3, 6, 1)},
    "transfer_entropy": {"k_history": (1, 3, 1), "bins": (4, 10, 1)},
}
SIGNAL_KNOBS = {"vector_mag": {"div": (30, 36, 1)}, "vector_phase": {"div": (30, 36, 1)}, "complex_field": {"div": (30, 36, 1)}}
REORDERS = ("identity", "reverse", "block", "shuffle")
DEPTH = 2
UNIVARIATE = [t for t in statistics.TESTS if t not in statistics.PAIRED]


def _drawn(ranges: dict, rng: random.Random) -> dict:
    out = {}
    for name, (low, high, step) in ranges.items():
        value = low + step * rng.randrange(int(round((high - low) / step)) + 1)
        out[name] = round(value, 6) if isinstance(step, float) else int(value)
    return out


def random_knobs(test: str, rng: random.Random) -> dict:
    return _drawn(KNOBS.get(test, {}), rng)


def _nudged(own: dict, ranges: dict, rng: random.Random) -> dict:
    """One knob a step up or down, within its range."""
    if not ranges:
        return own
    name = rng.choice(sorted(ranges))
    low, high, step = ranges[name]
    value = min(high, max(low, own.get(name, low) + step * rng.choice((-1, 1))))
    return own | {name: round(value, 6) if isinstance(step, float) else int(value)}


def random_formula(rng: random.Random, depth: int = 0) -> dict:
    names = list(signals.SIGNALS)
    b = random_formula(rng, depth + 1) if depth < 1 and rng.random() < 0.3 else rng.choice(names)
    return {"op": rng.choice(formula.OPS), "a": rng.choice(names), "b": b, "k": rng.randint(1, 10), "read": rng.choice(formula.READS)}


def random_genome(rng: random.Random, tests: list[str] = UNIVARIATE, prune: frozenset = frozenset()) -> dict:
    """A genome whose signal is not pruned; signals come from the registry as it is now. Three in ten look at reordered draws."""
    test = rng.choice(tests)
    names = [n for n in signals.SIGNALS if n not in prune] or list(signals.SIGNALS)
    sig = "comp" if rng.random() < 0.4 else rng.choice(names)
    params = {"_sig": _drawn(SIGNAL_KNOBS.get(sig, {}), rng), "_test": random_knobs(test, rng), "_reorder": rng.choice(REORDERS) if rng.random() < 0.3 else "identity"}
    if sig == "comp":
        params["_comp"] = random_formula(rng)
    return {"sig": sig, "test": test, "params": params}


def mutate(genome: dict, rng: random.Random, tests: list[str] | None = None) -> dict:
    """Another test or signal, a knob a step away, another part of the formula; now and then another order of the draws."""
    out = json.loads(json.dumps(genome))
    params, kind = out["params"], rng.random()
    if out["sig"] == "comp":
        if kind < 0.3:
            params["_test"] = _nudged(params.get("_test", {}), KNOBS.get(out["test"], {}), rng)
        else:
            part = rng.choice(("op", "a", "b", "k", "read"))
            params["_comp"][part] = random_formula(rng)[part]
    elif kind < 0.15 and tests:
        out["test"] = rng.choice(tests)
        params["_test"] = random_knobs(out["test"], rng)
    elif kind < 0.35:
        out["sig"] = rng.choice(list(signals.SIGNALS))
        params["_sig"] = _drawn(SIGNAL_KNOBS.get(out["sig"], {}), rng)
    elif kind < 0.85 or out["sig"] not in SIGNAL_KNOBS:
        params["_test"] = _nudged(params.get("_test", {}), KNOBS.get(out["test"], {}), rng)
    else:
        params["_sig"] = _nudged(params.get("_sig", {}), SIGNAL_KNOBS[out["sig"]], rng)
    if rng.random() < 0.12:
        params["_reorder"] = rng.choice(REORDERS)
    return out


def recombine(a: dict, b: dict, rng: random.Random) -> dict:
    """The signal of one, with its knobs and order, under the test of the other, with that test's knobs."""
    params = json.loads(json.dumps(a["params"])) | {"_test": dict(b["params"].get("_test", {}))}
    out = {"sig": a["sig"], "test": b["test"], "params": params}
    return mutate(out, rng) if rng.random() < 0.2 else out


def cross(a: dict, b: dict, rng: random.Random) -> dict:
    """A formula with one operand replaced by the other formula, flattened to its first signal where depth would exceed two."""
    leaf = lambda f: f if isinstance(f, str) else leaf(f["a"])
    out = json.loads(json.dumps(a))
    out["b"] = json.loads(json.dumps(b)) if formula.depth_of(b) < 2 else leaf(b)
    return out


def nest(f: dict, rng: random.Random) -> dict:
    """A formula one level deeper: an operand that is a signal becomes a formula of two signals. At full depth it stays."""
    out = json.loads(json.dumps(f))
    leaves = [part for part in ("a", "b") if isinstance(out.get(part), str)]
    if formula.depth_of(out) >= DEPTH or not leaves:
        return out
    child = random_formula(rng, 1)
    out[rng.choice(leaves)] = child
    return out


def breed(elites: list[dict], rng: random.Random, n: int = 6, tests=("mi_max", "acf_max")) -> tuple[list[dict], int]:
    """(genomes, generation) from formulas that passed: up to half of them mutated elites, the others crossed, mutated or new,
    each nested with chance one half. The generation is the greatest depth. Tests take turns."""
    pool = []
    for f in elites[: n // 2]:
        pool.append(mutate({"sig": "comp", "test": tests[0], "params": {"_comp": f, "_test": {}}}, rng)["params"]["_comp"])
    while len(pool) < n:
        if len(elites) > 1 and rng.random() < 0.6:
            child = cross(*rng.sample(elites, 2), rng)
        else:
            child = json.loads(json.dumps(rng.choice(elites))) if elites and rng.random() < 0.5 else random_formula(rng)
        child = nest(child, rng) if rng.random() < 0.5 else child
        if formula.depth_of(child) <= DEPTH:
            pool.append(child)
    pool = [f for f in pool if formula.depth_of(f) <= DEPTH]
    made = [{"sig": "comp", "test": tests[i % len(tests)], "params": {"_sig": {}, "_test": random_knobs(tests[i % len(tests)], rng), "_reorder": "identity", "_comp": f}} for i, f in enumerate(pool)]
    return made, max(formula.depth_of(f) for f in pool)


def key_of(genome: dict) -> str:
    return formula.key(genome["sig"], genome["test"], genome["params"])


def series_key(genome: dict) -> str:
    """What tells the series of two genomes apart."""
    p = genome["params"]
    return json.dumps([genome["sig"], p.get("_sig") or {}, p.get("_comp"), p.get("_reorder") or "identity"], sort_keys=True)


def series_of(draws: DataFrame, genomes: list[dict], seed: int = 0) -> DataFrame:
    """(series_id, t, x, y) of the genomes' series, y being the blue ball: row-local signals of one order of the draws in one pass,
    formulas each by its own plan."""
    out, by_order = None, {}
    for g in genomes:
        by_order.setdefault(g["params"].get("_reorder") or "identity", {})[series_key(g)] = g
    n = draws.count() if any(order in ("reverse", "block") for order in by_order) else 0
    for order, own in by_order.items():
        d = series.reordered(draws.select("t", "reds", "blue"), order, n, seed)
        local = {k: g for k, g in own.items() if g["sig"] in signals.SIGNALS}
        parts = []
        if local:
            cells = [F.struct(F.lit(k).alias("series_id"), signals.column(g["sig"], **(g["params"].get("_sig") or {})).alias("x")) for k, g in local.items()]
            parts.append(d.select("t", F.col("blue").cast("double").alias("y"), F.explode(F.array(*cells)).alias("s")).select("s.series_id", "t", "s.x", "y"))
        for k, g in own.items():
            if k not in local:
                x = formula.evaluate(d, g["params"]["_comp"]) if g["sig"] == "comp" else signals.SERIES[g["sig"]](d)
                parts.append(x.join(d.select("t", F.col("blue").cast("double").alias("y")), "t").select(F.lit(k).alias("series_id"), "t", F.col("x").cast("double").alias("x"), "y"))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def evaluate_genomes(draws: DataFrame, genomes: list[dict], *, k_light: int = 40, k_heavy: int = 20, null: str = "shuffle", seed: int = 0) -> list[dict]:
    """Evaluation rows of all genomes by one job (one more for paired tests, whose target is the blue ball); few rows come back."""
    return evaluate_islands(draws, {seed: genomes}, k_light=k_light, k_heavy=k_heavy, null=null)[seed]


def evaluate_islands(draws: DataFrame, islands: dict[int, list[dict]], *, k_light: int = 40, k_heavy: int = 20, null: str = "shuffle") -> dict[int, list[dict]]:
    """The same for the genomes of several seeds, each against its own seed's surrogates, by the same one or two jobs."""
    found: dict[int, list[dict]] = {seed: [] for seed in islands}
    for paired in (False, True):
        rows, jobs, seeds = None, {}, {}
        columns = ["x", "y"] if paired else ["x"]
        for seed, genomes in islands.items():
            own = [g for g in genomes if (g["test"] in statistics.PAIRED) == paired]
            if not own:
                continue
            for g in own:
                name = f"{seed}|{series_key(g)}"
                one = (g["test"], g["params"].get("_test") or {}, k_light if statistics.TESTS[g["test"]][2] == "light" else k_heavy)
                seeds[name] = seed
                if one not in jobs.setdefault(name, []):
                    jobs[name].append(one)
            made = series_of(draws, own, seed).withColumn("series_id", F.concat(F.lit(f"{seed}|"), "series_id"))
            rows = made if rows is None else rows.unionByName(made)
        if rows is None:
            continue
        used = "shuffle" if paired else null
        got = {(r.series_id, r.test, r.knobs): r.asDict() for r in evaluation.grid(rows.select("series_id", "t", *columns), jobs, null=used, seeds=seeds).collect()}
        for seed, genomes in islands.items():
            for g in genomes:
                r = got.get((f"{seed}|{series_key(g)}", g["test"], json.dumps(g["params"].get("_test") or {}, sort_keys=True)))
                if r is not None and (g["test"] in statistics.PAIRED) == paired:
                    _, direction, tier = statistics.TESTS[g["test"]]
                    found[seed].append(r | {"series_id": series_key(g), "sig": g["sig"], "direction": direction, "tier": tier, "sur_type": null, "params": json.dumps(g["params"], sort_keys=True), "gkey": key_of(g)})
    return found


@dataclass
class Frontier:
    """What searches carry over: the best genomes, what was tried, and results by (key, fingerprint, k, null, seed)."""

    elites: list[dict] = field(default_factory=list)
    tried: set[str] = field(default_factory=set)
    cache: dict[tuple, dict] = field(default_factory=dict)
    best_z: list[float] = field(default_factory=list)

    def save(self, spark, path: str) -> None:
        """Write elites, tried keys and results as Parquet tables under path, replacing what is there."""
        text = lambda rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
        tables = {"elites": text(self.elites), "tried": text(sorted(self.tried)), "best_z": text(self.best_z), "cache": text([[list(k), v] for k, v in self.cache.items()])}
        for name, table in tables.items():
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "Frontier":
        """The frontier written there; an empty one if there is none."""
        def rows(name: str) -> list:
            try:
                return [json.loads(r.value) for r in spark.read.schema("value string").parquet(f"{path}/{name}").collect()]
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                return []

        return cls(elites=rows("elites"), tried=set(rows("tried")), best_z=rows("best_z"), cache={tuple(k): v for k, v in rows("cache")})

    @property
    def coverage(self) -> int:
        return len(self.tried)

    def update(self, evals: list[dict], most: int = 12) -> None:
        """Elites are the most extreme in their test's own direction."""
        sign = lambda e: e["z"] if e["direction"] == "high" else -e["z"]
        best = {e["gkey"]: e for e in [*self.elites, *evals]}
        self.elites = sorted(best.values(), key=lambda e: (-sign(e), e["gkey"]))[:most]
        self.tried |= {e["gkey"] for e in evals}
        self.best_z.append(max((sign(e) for e in self.elites), default=0.0))


def _evolution(epochs: int, pop: int, seed: int, frontier: Frontier, tests: list[str], prune: frozenset, tag: tuple, store):
    """A search as a generator: yields the genomes that it needs evaluated, is sent their rows, returns all its evaluations."""
    rng = random.Random(seed)
    genome = lambda e: {"sig": e["sig"], "test": e["test"], "params": json.loads(e["params"])}
    population = [genome(e) for e in frontier.elites[: pop // 3]]
    evals: list[dict] = []
    for _ in range(epochs):
        for _ in range(200):
            if len(population) >= pop:
                break
            new = random_genome(rng, tests, prune)
            if key_of(new) not in frontier.tried:
                population.append(new)
        unique = {key_of(g): g for g in population}
        known = {k: v for k in ((key, *tag) for key in unique) if (v := frontier.cache.get(k)) is not None} if store is None else store.get([(key, *tag) for key in unique])
        fresh = yield [g for key, g in unique.items() if (key, *tag) not in known]
        added = {(e["gkey"], *tag): e for e in fresh}
        frontier.cache.update(added) if store is None else store.put(added)
        got = sorted([*known.values(), *fresh], key=lambda e: (e["p_raw"], e["gkey"]))
        evals += got
        frontier.update(got)
        half = [genome(e) for e in got[: max(2, len(got) // 2)]]
        population = [recombine(rng.choice(half), rng.choice(half), rng) if rng.random() < 0.5 else mutate(rng.choice(half), rng, tests) for _ in range(pop)] if half else []
        population = [g for g in population if key_of(g) not in frontier.tried]
    return list({e["gkey"]: e for e in evals}.values())


def _together(searches: dict, evaluate) -> dict:
    """Run generators step by step: what all of them ask for goes to evaluate({name: genomes}) at once. {name: what it returned}."""
    done, wanted, rows = {}, {}, dict.fromkeys(searches)
    while searches:
        for name in list(searches):
            try:
                wanted[name] = searches[name].send(rows[name])
            except StopIteration as end:
                done[name] = end.value
                del searches[name]
                wanted.pop(name, None)
        asked = {name: genomes for name, genomes in wanted.items() if genomes}
        rows = {name: [] for name in wanted} | (evaluate(asked) if asked else {})
    return done


def evolve(draws: DataFrame, *, epochs: int = 3, pop: int = 12, seed: int = 0, frontier: Frontier | None = None, tests: list[str] = UNIVARIATE, fingerprint: str = "", prune: frozenset = frozenset(), store=None, **options) -> tuple[list[dict], Frontier]:
    """Epochs of proposal and evaluation; the better half by p breeds the next. Tried genomes are skipped. Results are looked up
    in, and added to, the frontier's cache or a shared table `store` (sources.evaluations.Evaluations)."""
    found, frontiers = evolve_seeds(draws, [seed], epochs=epochs, pop=pop, frontiers={seed: frontier or Frontier()}, tests=tests, fingerprint=fingerprint, prune=prune, store=store, **options)
    return found[seed], frontiers[seed]


def evolve_seeds(draws: DataFrame, seeds: list[int], *, epochs: int = 3, pop: int = 12, frontiers: dict[int, Frontier] | None = None, tests: list[str] = UNIVARIATE, fingerprint: str = "", prune: frozenset = frozenset(), store=None, **options) -> tuple[dict[int, list[dict]], dict[int, Frontier]]:
    """({seed: evaluations}, {seed: frontier}): a search for each seed, as evolve() makes it alone. An epoch of all seeds is one
    job (one more where paired tests are among them)."""
    frontiers = frontiers or {seed: Frontier() for seed in seeds}
    k = (options.get("k_light", 40), options.get("k_heavy", 20), options.get("null", "shuffle"))
    searches = {seed: _evolution(epochs, pop, seed, frontiers[seed], tests, prune, (fingerprint, *k, seed), store) for seed in seeds}
    return _together(searches, lambda asked: evaluate_islands(draws, asked, **options)), frontiers


def seed_candidates(spark, found: dict[int, list[dict]], below: float = 0.2) -> DataFrame:
    """What seeds send on: (seed, sig, test, params, p_raw, z, tier) of their evaluations with p below the bound, for
    sources.logs.merged() and gates.ingest(). Some dozens a seed."""
    rows = [(seed, e["sig"], e["test"], e["params"], float(e["p_raw"]), float(e["z"]), e["tier"]) for seed, evals in found.items() for e in evals if e["p_raw"] < below]
    return spark.createDataFrame(rows, "seed long, sig string, test string, params string, p_raw double, z double, tier string")


def _climb(sig: str, test: str, comp: dict | None, steps: int, anchors: int):
    """Tuning as a generator: yields the genomes that it needs, is sent their rows, returns (knobs, the most extreme z)."""
    sign = 1 if statistics.TESTS[test][1] == "high" else -1
    memo: dict[str, float] = {}

    def scores(settings: list[dict]):
        rows = yield [{"sig": sig, "test": test, "params": {"_test": s} | ({"_comp": comp} if comp else {})} for s in settings if json.dumps(s, sort_keys=True) not in memo]
        for e in rows:
            memo[json.dumps(json.loads(e["params"])["_test"], sort_keys=True)] = sign * e["z"]
        return [memo.get(json.dumps(s, sort_keys=True), -math.inf) for s in settings]

    fit = lambda v, spec: round(min(max(v, spec[0]), spec[1]), 6) if isinstance(spec[2], float) else int(min(max(round(v), spec[0]), spec[1]))
    spec = KNOBS.get(test, {})
    best = {name: fit((s[0] + s[1]) / 2, s) for name, s in spec.items()}
    top = (yield from scores([best]))[0]
    for name, s in spec.items():
        grid = [best | {name: fit(s[0] + (s[1] - s[0]) * i / max(1, anchors - 1), s)} for i in range(anchors)]
        got = yield from scores(grid)
        if max(got) > top:
            top, best = max(got), grid[got.index(max(got))]
    size = {name: (s[1] - s[0]) / 4 for name, s in spec.items()}
    for _ in range(steps):
        near = [best | {name: fit(best[name] + d * size[name], spec[name])} for name in spec for d in (-1, 1)]
        got = (yield from scores(near)) if near else []
        if got and max(got) > top:
            top, best = max(got), near[got.index(max(got))]
        else:
            size = {name: v / 2 for name, v in size.items()}
    return best, top


def _climbed(part: DataFrame, templates: list[tuple], k: int, steps: int, anchors: int, seed: int) -> list[tuple[dict, float]]:
    """(knobs, z) of templates (sig, test, comp); a step of all of them is one job."""

    def evaluate(asked: dict[int, list[dict]]) -> dict[int, list[dict]]:
        unique = {key_of(g): g for own in asked.values() for g in own}
        got = {e["gkey"]: e for e in evaluate_genomes(part, list(unique.values()), k_light=k, k_heavy=k, seed=seed)}
        return {i: [got[key_of(g)] for g in own if key_of(g) in got] for i, own in asked.items()}

    done = _together({i: _climb(*t, steps, anchors) for i, t in enumerate(templates)}, evaluate)
    return [done[i] for i in range(len(templates))]


def tune(draws: DataFrame, sig: str, test: str, *, comp: dict | None = None, discovery: float = 0.7, k: int = 40, steps: int = 4, anchors: int = 6, seed: int = 0) -> tuple[dict, float]:
    """The test's knobs with the most extreme z on the discovery part: a grid of anchors for each knob, evaluated together,
    then coordinate steps of half the size until none helps."""
    part = draws.where(F.col("t") < int(draws.count() * discovery))
    return _climbed(part, [(sig, test, comp)], k, steps, anchors, seed)[0]


# What the formula search tunes, as (signal, test).
POOL = (("red_sum", "acf_max"), ("red_sum", "mi_max"), ("red_sum", "dfa_alpha"), ("red_sum", "perm_entropy"), ("blue", "acf_max"), ("blue", "mi_max"), ("comp", "acf_max"), ("comp", "mi_max"), ("comp", "dfa_alpha"))


def diff_search(draws: DataFrame, *, candidates: int = len(POOL), discovery: float = 0.7, k: int = 40, steps: int = 4, anchors: int = 6, seed: int = 0) -> list[dict]:
    """Records (sig, test, params, z, disc_p) of the pool's templates, each tuned on the discovery part only and then measured
    there once more with surrogates it was not tuned on. What they are worth is for the gates to say."""
    rng, part = random.Random(seed), draws.where(F.col("t") < int(draws.count() * discovery))
    templates = [(sig, test, random_formula(rng) if sig == "comp" else None) for sig, test in (POOL[i % len(POOL)] for i in range(candidates))]
    tuned = _climbed(part, templates, k, steps, anchors, seed)
    out = [{"sig": sig, "test": test, "params": {"_test": knobs} | ({"_comp": comp} if comp else {}), "z": z} for (sig, test, comp), (knobs, z) in zip(templates, tuned)]
    got = {e["gkey"]: e["p_raw"] for e in evaluate_genomes(part, out, k_light=k, k_heavy=k, seed=seed + 1)}
    return [r | {"disc_p": got.get(key_of(r))} for r in out]
