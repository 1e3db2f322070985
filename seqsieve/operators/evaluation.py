"""From statistics of a real series and its surrogates to p-values, and corrections over many of them."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.operators import resampling, series, spectrum, statistics
from seqsieve.sources.shared import written


def can_reach(k: int, level: float) -> None:
    """An error if k surrogates cannot give a p below the level, as a gate at that level could then not speak."""
    if 1 / (1 + k) >= level:
        raise ValueError(f"{k} surrogates give no p below {1 / (1 + k):.4g}, and the level asked for is {level}")


def rank_p(real: DataFrame, surrogates: DataFrame, keys: list[str], direction: str = "high") -> DataFrame:
    """real(keys, stat) and surrogates(keys, sid, stat) to evaluation rows. p = (1 + surrogates as extreme) / (1 + k);
    z is 0 for a spread below 1e-6 and bounded by 1000; surrogates that cannot be evaluated do not count."""
    rows = surrogates.where("stat is not null").select(*keys, F.col("stat").alias("s")).join(real.where("stat is not null"), keys)
    beyond = F.col("s") >= F.col("stat") if direction == "high" else F.col("s") <= F.col("stat")
    out = rows.groupBy(*keys).agg(F.max("stat").alias("stat"), F.avg("s").alias("sur_mean"), F.stddev_pop("s").alias("sur_std"), F.sum(beyond.cast("int")).alias("hits"), F.count(F.lit(1)).alias("k_sur"), F.max("s").alias("sur_max"), F.min("s").alias("sur_min"))
    z = F.when(F.col("sur_std") < 1e-6, 0.0).otherwise((F.col("stat") - F.col("sur_mean")) / F.when(F.col("sur_std") >= 1e-6, F.col("sur_std")))
    return out.select(*keys, "stat", "sur_mean", "sur_std", F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), z)).alias("z"), ((1 + F.col("hits")) / (1 + F.col("k_sur"))).alias("p_raw"), "k_sur", "sur_max", "sur_min")


#: Bytes of the permutations or phases that a task remembers, and values that it looks at, at least, before there are more tasks.
REMEMBERED, ENOUGH = 1 << 27, 1 << 18


class Held(NamedTuple):
    """Series written for grids: (series_id, size, s, columns) in stretches, and (series_id, n)."""

    rows: DataFrame
    sizes: DataFrame
    columns: list[str]
    longest: int
    total: int


def held_for_grids(rows: DataFrame) -> Held:
    """Series (series_id, t, x[, y]), or packed ones (series_id, x[, y]), made and written once, for one grid or several."""
    columns = [c for c in ("x", "y") if c in rows.columns]
    out = written(statistics.pieces(rows, columns).repartition(rows.sparkSession.sparkContext.defaultParallelism, "series_id", "s"), "series")
    sizes = written(out.groupBy("series_id").agg(F.sum("size").alias("n")), "sizes")
    longest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (longest or 0) > statistics.PASSES:
        raise ValueError(f"a series of more than {statistics.PASSES} points does not fit a task: use the distributed forms of statistics.DISTRIBUTED")
    return Held(out, sizes, columns, longest or 0, total or 0)


def grid(held: DataFrame | Held, jobs: dict[str | None, list[tuple[str, dict, int]]], *, null: str = "shuffle", seed: int = 0, parts: int | None = None, bundles: int = 1, seeds: dict[str, int] | None = None) -> DataFrame:
    """Evaluation rows (series_id, test, knobs, stat, sur_mean, ..., sur_min) of series (series_id, t, x[, y]) or packed ones
    (series_id, x[, y]), or of those that held_for_grids() has written.

    jobs has (test, knobs, k) for a series_id, or under None for all others. The surrogates of a seed are dealt into `parts` (as many
    as the values ask for and the permutations of a part fit in REMEMBERED). A task makes the permutations of its part once and lets
    all series of that seed go by, one at a time, in stretches: surrogates are neither stored nor moved, and a task holds one
    series. With `bundles`, a part's series are dealt to so many tasks, each of which makes the part's permutations. What comes back
    is a number for each surrogate and test. seeds has the seeds of series with their own, whose ids then are the seed, a bar,
    and what the id would be without.
    """
    import json
    from functools import reduce

    import numpy as np
    import pyarrow as pa

    rows, sizes, columns, longest, total = held if isinstance(held, Held) else held_for_grids(held)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most: dict[int, int] = {}
    for name, own in jobs.items():
        of = (seeds or {}).get(name, seed)
        most[of] = max(most.get(of, 0), *(k + 1 for _, _, k in own), 1)  # surrogates, and the series itself as number -1
    if parts is None:
        work = total * max(most.values(), default=0)
        fit = max(1, REMEMBERED // max(1, longest * (8 if null == "aaft" else 4)))
        wanted = min(4 * cores, -(-work // ENOUGH))
        parts = max(1, wanted // max(1, len(most)), *(-(-k // fit) for k in most.values()))
    dealt = [(of, part) for of, k in most.items() for part in range(min(parts, k))]
    place = {of: ([i for i, d in enumerate(dealt) if d[0] == of]) for of in most}

    def results(name, values, own, of, part, orders):
        shared: dict = {}
        for sid in range(part - 1, max((j for _, _, j in own), default=0), min(parts, most[of])):
            wanted = [(test, knobs) for test, knobs, j in own if sid < j]
            if wanted:
                made = values if sid < 0 else resampling.surrogate(values, null, of, name.split("|", 1)[1] if seeds else name, sid, orders, shared)
                made = [np.asarray(v, float) for v in made]
                for test, knobs in wanted:
                    stat = statistics.TESTS[test][0](*made, **knobs)
                    yield name, test, json.dumps(knobs, sort_keys=True), sid, float(stat) if np.isfinite(stat) else None

    def run(batches):
        """Rows come by part, length and series."""
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64())
        table = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["series_id", "test", "knobs", "sid", "stat"])
        last, found, orders, at = None, {}, {}, None

        def ended():
            nonlocal orders, at
            where, name = last
            if where != at:
                orders, at = {}, where
            values = [statistics.of_bytes(found.pop(c)) for c in columns]
            return table(list(results(name, values, jobs.get(name, jobs.get(None, [])), *dealt[where // bundles], orders)))

        for batch in batches:
            for i, key in enumerate(zip(batch.column("part").to_pylist(), batch.column("series_id").to_pylist())):
                if key != last:
                    if last is not None:
                        yield ended()
                    last, found = key, {c: [] for c in columns}
                for c in columns:
                    found[c].append(batch.column(c)[i].as_py())
        if last is not None:
            yield ended()

    where = lambda of: F.array(*[F.lit(i) for i in place.get(of, [])]).cast("array<int>")
    if seeds:
        of = F.substring_index("series_id", "|", 1).cast("long")
        to = reduce(lambda to, s: F.when(of == s, where(s)).otherwise(to), place, where(None))
    else:
        to = where(seed)
    spread = rows.join(sizes, "series_id").select("series_id", "n", "s", F.explode(to).alias("part"), *columns)
    spread = spread.withColumn("part", (F.col("part") * bundles + F.pmod(F.xxhash64("series_id"), F.lit(bundles))).cast("int"))
    rows = spread.repartitionById(max(1, len(dealt) * bundles), "part").sortWithinPartitions("part", "n", "series_id", "s").select("part", "series_id", *columns)
    stats = rows.mapInArrow(run, "series_id string, test string, knobs string, sid int, stat double").where("stat is not null")
    # A series' statistics under one test are as many as its surrogates: k numbers meet in one row.
    own = F.col("sid") < 0
    one = stats.groupBy("series_id", "test", "knobs").agg(F.max(F.when(own, F.col("stat"))).alias("stat"), F.collect_list(F.when(~own, F.col("stat"))).alias("s"))
    high = F.col("test").isin(*[t for t, (_, way, _) in statistics.TESTS.items() if way == "high"])
    mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.col("k_sur")
    spread = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + (v - F.col("sur_mean")) * (v - F.col("sur_mean"))) / F.col("k_sur"))
    hits = F.size(F.filter("s", lambda v: F.when(high, v >= F.col("stat")).otherwise(v <= F.col("stat"))))
    one = one.withColumn("k_sur", F.size("s").cast("long")).where("stat is not null and k_sur > 0").withColumn("sur_mean", mean).withColumn("sur_std", spread)
    z = F.when(F.col("sur_std") < 1e-6, 0.0).otherwise((F.col("stat") - F.col("sur_mean")) / F.when(F.col("sur_std") >= 1e-6, F.col("sur_std")))
    return one.select("series_id", "test", "knobs", "stat", "sur_mean", "sur_std", F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), z)).alias("z"), ((1 + hits) / (1 + F.col("k_sur"))).alias("p_raw"), "k_sur", F.array_max("s").alias("sur_max"), F.array_min("s").alias("sur_min"))


def labelled(rows: DataFrame, null: str) -> DataFrame:
    """Rows of grid() with the tests' tiers and directions, and the kind of surrogates."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(v) for t, d in statistics.TESTS.items() for v in (t, d[i])]), F.col("test"))
    return rows.select(F.col("series_id").alias("sig"), "test", pick(2).alias("tier"), pick(1).alias("direction"), F.lit(null).alias("sur_type"), *rows.columns[3:])


def evaluate(rows: DataFrame, tests: list[str], *, k: int | dict[str, int], null: str = "shuffle", seed: int = 0, knobs: dict | None = None) -> DataFrame:
    """Evaluation rows of every series (series_id, t, x) under every test; k surrogates, or so many by test."""
    many = lambda t: k if isinstance(k, int) else k[t]
    jobs = {None: [(t, (knobs or {}).get(t, {}), many(t)) for t in tests]}
    return labelled(grid(rows, jobs, null=null, seed=seed), null)


def evaluate_long(rows: DataFrame, test: str, *, k: int, null: str = "shuffle", seed: int = 0, **knobs) -> DataFrame:
    """The same for series of any length, under a test with a distributed form, against the same surrogates. A paired test takes
    (series_id, t, x, y), whose columns are shuffled together."""
    measured, columns = statistics.DISTRIBUTED[test], ["x", "y"] if test in statistics.PAIRED else ["x"]
    if null == "shuffle":
        made = resampling.shuffled(rows.select("series_id", "t", *columns), k, seed, ["series_id"])
    elif null in ("aaft", "iaaft") and len(columns) == 1:
        made = spectrum.randomised(rows, k, seed, ["series_id"], rounds=5 if null == "iaaft" else 0)
    else:
        raise ValueError(f"{null} surrogates of {test} have no distributed form")
    out = rank_p(measured(rows, ["series_id"], **knobs), measured(made, ["series_id", "sid"], **knobs), ["series_id"], statistics.TESTS[test][1])
    return labelled(out.select("series_id", F.lit(test).alias("test"), F.lit("").alias("knobs"), *out.columns[1:]), null)


def evaluate_pair(rows: DataFrame, tests: str | list[str], *, k: int, seed: int = 0, **knobs) -> DataFrame:
    """Evaluation rows of (series_id, t, x, y): surrogates shuffle x and y by the same permutation, which keeps what they share
    at one time and breaks what passes from one to the next."""
    jobs = {None: [(t, knobs, k) for t in ([tests] if isinstance(tests, str) else tests)]}
    return grid(rows.select("series_id", "t", "x", "y"), jobs, seed=seed).drop("knobs")


def bh_fdr(evals: DataFrame, p: str = "p_raw", keys: list[str] = (), name: str = "q", parts: int | None = None) -> DataFrame:
    """evals with Benjamini-Hochberg q-values within the keys; a null p, or one that is no number, counts as no hypothesis and gets a null q.

    Equal p-values are counted first. The different ones are parted at about equal quantiles; counts of the parts give ranks
    of their starts, and the least of the later parts goes to the earlier ones, so no task sorts all of them. The evaluations,
    and what is found of them on the way, are written first, as each is read more than once.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))  # compares nulls as equal
    evals = written(evals.withColumn("_g", group), "evals")
    counts = evals.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy("_g", F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    if parts is None:  # some 65,000 different values in a part
        most = counts.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        parts = max(64, -(-most // (1 << 16)))
    edges = counts.groupBy("_g").agg(F.percentile_approx("_p", [i / parts for i in range(1, parts)], max(1000, 10 * parts)).alias("_e"), F.sum("_c").alias("_n"))
    rows = counts.join(edges, "_g").withColumn("_part", F.size(F.filter("_e", lambda e: e < F.col("_p")))).drop("_e")
    rows = written(rows, "p-values")
    own, along = Window.partitionBy("_g", "_part"), Window.partitionBy("_g").orderBy("_part")  # at most `parts` parts of a group
    sums = rows.groupBy("_g", "_part").agg(F.sum("_c").alias("_s")).select("_g", "_part", (F.sum("_s").over(along) - F.col("_s")).alias("_before"))
    rows = rows.join(sums, ["_g", "_part"])
    rows = written(rows.withColumn("_q", F.col("_p") * F.col("_n") / (F.col("_before") + F.sum("_c").over(own.orderBy("_p")))), "q-values")
    later = Window.partitionBy("_g").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy("_g", "_part").agg(F.min("_q").alias("_m")).select("_g", "_part", F.min("_m").over(later).alias("_after"))
    q = F.least(F.lit(1.0), F.min("_q").over(own.orderBy(F.col("_p").desc())), F.col("_after"))
    found = rows.join(least, ["_g", "_part"]).select(F.col("_g").alias("_h"), "_p", F.greatest(F.lit(0.0), q).alias(name))
    return evals.join(found, (F.col("_g") == F.col("_h")) & (F.col(p) == F.col("_p")), "left").drop("_g", "_h", "_p")


def fisher(rows: DataFrame, keys: list[str], p: str = "p_raw") -> DataFrame:
    """(keys, n, p_comb): Fisher's combination. p outside (0, 1] is dropped; none gives 1. For 2n degrees of freedom the
    tail is exp(-h) * sum h^i / i!, i < n, with h = -sum ln p; terms are taken in logarithms, so none is out of range."""
    ok = F.when((F.col(p) > 0) & (F.col(p) <= 1), F.ln(p))
    one = rows.groupBy(*keys).agg((-F.coalesce(F.sum(ok), F.lit(0.0))).alias("h"), F.count(ok).cast("int").alias("n"))
    # ln of term i is i ln h - ln i! - h; each is below 0, and the sum of their exponentials is the tail.
    step = lambda a, i: F.struct((a["sum"] + F.exp(a["log"])).alias("sum"), (a["log"] + F.ln(F.greatest(F.col("h"), F.lit(1e-300))) - F.ln(i.cast("double"))).alias("log"))
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), F.struct(F.lit(0.0).alias("sum"), (-F.col("h")).alias("log")), step)
    return one.select(*keys, "n", F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), terms["sum"])).alias("p_comb"))


def folds(n: Column, n_folds: int = 3, discovery: float = 0.7, least: int = 30) -> Column:
    """array<struct<fold, d_end, c_start, c_end>>: growing discovery parts and disjoint confirmation blocks of the tail."""
    base = F.floor(n * discovery)
    tail = n - base
    size = F.floor(tail / n_folds)
    many = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: F.struct(f.alias("fold"), (base + f * size).alias("d_end"), (base + f * size).alias("c_start"), F.when(f == n_folds - 1, n).otherwise(base + (f + 1) * size).alias("c_end")))
    one = F.array(F.struct(F.lit(0).alias("fold"), base.alias("d_end"), base.alias("c_start"), n.alias("c_end")))
    return F.filter(F.when(tail < n_folds * least, one).otherwise(many), lambda s: s["c_end"] - s["c_start"] >= least)


def verdict(fold_ps: DataFrame, keys: list[str]) -> DataFrame:
    """fold_ps(keys, fold, disc_p, conf_p) to combined p-values, confirmed folds and a verdict.

    SIGNAL: both parts combined below .05 and most folds confirmed; UNCONFIRMED: discovery only; else NULL."""
    disc = fisher(fold_ps.where("disc_p is not null"), keys, "disc_p").select(*keys, F.col("p_comb").alias("disc_combined_p"))
    conf = fisher(fold_ps.where("conf_p is not null"), keys, "conf_p").select(*keys, F.col("n").alias("m"), F.col("p_comb").alias("conf_combined_p"))
    n = fold_ps.groupBy(*keys).agg(F.sum((F.col("conf_p") < 0.05).cast("int")).alias("n_confirm"))
    found = F.coalesce(F.col("disc_combined_p"), F.lit(1.0)) < 0.05
    held = (F.col("conf_combined_p") < 0.05) & (F.col("n_confirm") >= F.floor((F.col("m") + 1) / 2))
    return conf.join(disc, keys, "left").join(n, keys).select(*keys, F.coalesce("disc_combined_p", F.lit(1.0)).alias("disc_combined_p"), "conf_combined_p", "n_confirm", F.when(found & held, "SIGNAL").when(found, "UNCONFIRMED").otherwise("NULL").alias("verdict"))


def bands(evals: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """q-values over all evaluations; artifact signals are demoted to q = 1; bands at .05 and .2."""
    out = bh_fdr(evals)
    if artifacts is not None:
        out = out.join(artifacts.select("sig", F.lit(True).alias("artifact")).distinct(), "sig", "left")
        out = out.withColumn("artifact", F.coalesce("artifact", F.lit(False))).withColumn("q", F.when(F.col("artifact"), 1.0).otherwise(F.col("q")))
    return out.withColumn("verdict", F.when(F.col("q") < 0.05, "SIGNAL").when(F.col("q") < 0.2, "BORDERLINE").otherwise("NULL"))


def erf(x: Column) -> Column:
    """Error function by its series below 3 and its continued fraction above, to about 1e-12."""
    a = F.abs(x)
    low = F.least(a, F.lit(3.0))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(low.alias("sum"), low.alias("term")), lambda s, n: F.struct((s["sum"] + s["term"] * (-low * low / n) / (2 * n + 1)).alias("sum"), (s["term"] * (-low * low / n)).alias("term")))
    high = F.greatest(a, F.lit(3.0))
    tail = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(40))), F.lit(0.0), lambda s, k: (k / 2.0) / (high + s))
    large = 1 - F.exp(-high * high) / ((high + tail) * math.sqrt(math.pi))
    return F.signum(x) * F.when(a < 3, terms["sum"] * (2 / math.sqrt(math.pi))).otherwise(large)
