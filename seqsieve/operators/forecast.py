"""Forecasts of the next draw, back-tests, pre-registration and scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.functions import signals
from seqsieve.operators import evaluation, resampling, series, statistics

LOG_REDS = math.log(math.comb(33, 6))
LOG_BLUE = math.log(16.0)


def picks(draws: DataFrame, weight: Column, keys: list[str] = (), reds: int = 6) -> DataFrame:
    """(keys, reds, blue): balls with the most weight over the draws; ties go to the smaller ball. 49 sums for each key."""
    ball = F.explode(F.concat(F.transform("reds", lambda r: F.struct(F.lit("red").alias("colour"), r.alias("ball"))), F.array(F.struct(F.lit("blue").alias("colour"), F.col("blue").alias("ball")))))
    scores = draws.withColumn("_w", weight).select(*keys, "_w", ball.alias("b")).groupBy(*keys, "b.colour", "b.ball").agg(F.round(F.sum("_w"), 9).alias("score"))
    top = scores.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "colour").orderBy(F.col("score").desc(), "ball")))
    top = top.where(((F.col("colour") == "red") & (F.col("n") <= reds)) | ((F.col("colour") == "blue") & (F.col("n") == 1)))
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("colour") == "red", F.col("ball")))).alias("reds"), F.max(F.when(F.col("colour") == "blue", F.col("ball"))).alias("blue"))


def recency(draws: DataFrame, window: int = 150, decay: float = 0.97, compat: bool = False) -> DataFrame:
    """(reds, blue) from the last `window` draws, the newest with weight 1 (the oldest if compat), each step further `decay` of it."""
    n = draws.agg(F.count(F.lit(1)).alias("n"))
    recent = series.with_scalars(draws, n).where(F.col("t") >= F.col("n") - window)
    age = F.col("t") - F.greatest(F.lit(0), F.col("n") - window) if compat else F.col("n") - 1 - F.col("t")
    return picks(recent, F.pow(F.lit(decay), age))


def regime(draws: DataFrame, signal: str = "predict_gap_max", window: int = 150, decay: float = 0.97, tolerance: float = 1.6, last: int = 30, least: int = 20) -> DataFrame:
    """(reds, blue) from the draws whose signal lies near its mean over the last ones; the last `window` if those are few.
    Weights fall by the rank of the draw among those selected, newest first."""
    rows = draws.withColumn("v", signals.column(signal))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    rows = series.with_scalars(rows, n)
    mean = rows.where(F.col("t") >= F.col("n") - last).agg(F.avg("v").alias("regime"))
    near = series.with_scalars(rows, mean).where(F.abs(F.col("v") - F.col("regime")) <= tolerance)
    few = near.agg((F.count(F.lit(1)) < least).alias("few"))
    chosen = series.with_scalars(near, few).where("not few").select("t", "reds", "blue").union(series.with_scalars(rows.where(F.col("t") >= F.col("n") - window), few).where("few").select("t", "reds", "blue"))
    # Ranks are only taken among the newest draws: all weights beyond these sum to less than the scores are rounded to.
    enough = math.ceil(math.log(1e-12 * (1 - decay)) / math.log(decay)) if 0 < decay < 1 else None
    newest = chosen if enough is None else chosen.orderBy(F.col("t").desc()).limit(enough)
    ranked = newest.withColumn("age", F.row_number().over(Window.orderBy(F.col("t").desc())) - 1)
    return picks(ranked, F.pow(F.lit(decay), "age"))


def backtest(draws: DataFrame, targets: int = 500, window: int = 150, decay: float = 0.97) -> DataFrame:
    """(t, red_hits, blue_hit) for the last `targets` draws, each forecast from the `window` draws strictly before it.
    A draw joins the at most `window` targets that it serves, by an equi-join on t."""
    n = draws.agg(F.count(F.lit(1)).alias("n"))
    late = series.with_scalars(draws, n).where(F.col("t") >= F.col("n") - targets - window)  # others serve no target
    train = late.select("t", "reds", "blue", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("age")).withColumn("target", F.col("t") + F.col("age"))
    wanted = series.with_scalars(draws, n).where((F.col("t") >= F.col("n") - targets) & (F.col("t") > 0)).select(F.col("t").alias("target"), F.col("reds").alias("actual_reds"), F.col("blue").alias("actual_blue"))
    forecast = picks(train.join(wanted.select("target"), "target"), F.pow(F.lit(decay), F.col("age") - 1), ["target"])
    return forecast.join(wanted, "target").select(F.col("target").alias("t"), F.size(F.array_intersect("reds", "actual_reds")).alias("red_hits"), (F.col("blue") == F.col("actual_blue")).cast("int").alias("blue_hit"))


def backtest_summary(hits: DataFrame) -> DataFrame:
    """Number of targets, mean red hits, its z against 36/33, and blue hit rate."""
    var = 6 * (6 / 33) * (27 / 33) * (27 / 32)
    n = F.count(F.lit(1))
    return hits.agg(n.alias("n"), F.avg("red_hits").alias("mean_red_hits"), ((F.avg("red_hits") - 36 / 33) / F.sqrt(var / n)).alias("z"), F.avg("blue_hit").alias("blue_rate"))


_BALLS = "concat(transform(reds, r -> struct('red' as colour, r as ball)), array(struct('blue' as colour, blue as ball)))"


def signal_picks(train: DataFrame, keys: list[str] = (), reds: int = 6) -> DataFrame:
    """(keys, colour, ball): the six red balls and the blue one whose frequency differs most between the draws of train(keys, v,
    reds, blue) above the median of v and the others; ties go to the smaller ball."""
    keys = list(keys)
    med = train.groupBy(*keys).agg(F.percentile("v", 0.5).alias("med"))
    rows = train.join(med, keys) if keys else series.with_scalars(train, med)
    rows = rows.withColumn("hi", F.col("v") > F.col("med"))
    sides = rows.groupBy(*keys).agg(F.sum(F.col("hi").cast("int")).alias("hi_n"), F.sum((~F.col("hi")).cast("int")).alias("lo_n"))
    freq = rows.select(*keys, "hi", F.explode(F.expr(_BALLS)).alias("b")).groupBy(*keys, "b.colour", "b.ball").agg(F.sum(F.col("hi").cast("int")).alias("h"), F.sum((~F.col("hi")).cast("int")).alias("l"))
    freq = freq.join(sides, keys) if keys else series.with_scalars(freq, sides)
    gap = F.abs(F.col("h") / F.nullif(F.col("hi_n"), F.lit(0)) - F.col("l") / F.nullif(F.col("lo_n"), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys, "colour").orderBy(F.col("score").desc(), "ball"))  # 33 balls and 16
    return freq.withColumn("score", F.round(F.coalesce(gap, F.lit(0.0)), 12)).withColumn("k", place).where(((F.col("colour") == "red") & (F.col("k") <= reds)) | ((F.col("colour") == "blue") & (F.col("k") == 1))).select(*keys, "colour", "ball")


def _parted(draws: DataFrame, signal: str, frac: float) -> tuple[DataFrame, DataFrame]:
    """Training draws with v, and the rest without repeats."""
    rows = draws.withColumn("v", signals.column(signal))
    rows = series.with_scalars(rows, rows.agg(F.count(F.lit(1)).alias("n"))).withColumn("cut", F.floor(F.col("n") * (1 - frac)))
    return rows.where("t < cut").select("t", "reds", "blue", "v"), rows.where("t >= cut").dropDuplicates(["reds", "blue"])


def pick_by_signal(draws: DataFrame, signal: str, frac: float = 0.2) -> DataFrame:
    """One row (train_n, test_n, red_hits, red_expected, blue_hits, blue_expected): in the training part, balls whose
    frequency differs most between draws above and below the signal's median are picked; hits are counted in the rest."""
    train, rest = _parted(draws, signal, frac)
    is_red = F.col("colour") == "red"
    chosen = signal_picks(train).agg(F.array_sort(F.collect_list(F.when(is_red, F.col("ball")))).alias("pick_reds"), F.max(F.when(~is_red, F.col("ball"))).alias("pick_blue"))
    test = series.with_scalars(rest, chosen)
    n = F.count(F.lit(1))
    return test.agg(F.max("cut").alias("train_n"), n.alias("test_n"), F.sum(F.size(F.array_intersect("reds", "pick_reds"))).alias("red_hits"), (n * 36 / 33).alias("red_expected"), F.sum((F.col("blue") == F.col("pick_blue")).cast("int")).alias("blue_hits"), (n / 16).alias("blue_expected"))


def pick_accuracy(draws: DataFrame, signal: str, frac: float = 0.2, *, k: int = 100, seed: int = 0) -> DataFrame:
    """One row (hits, sur_mean, as_good, k_sur, p): the picks' hits beside those of picks made after the signal was shuffled
    against the training draws, which breaks what it says of them. Hits of a pick are a sum over the picked balls' own counts
    in the rest, so surrogates never meet the draws there."""
    train, rest = _parted(draws, signal, frac)
    counts = rest.select(F.explode(F.expr(_BALLS)).alias("b")).groupBy("b.colour", "b.ball").agg(F.count(F.lit(1)).alias("c"))
    moved = resampling.shuffled(train.select("t", "v"), k, seed).join(train.select("t", "reds", "blue"), "t")
    hits = lambda picked, keys: picked.join(F.broadcast(counts), ["colour", "ball"], "left").groupBy(*keys).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("h"))  # noqa: E731  49 rows at most
    real = hits(signal_picks(train), []).withColumnRenamed("h", "hits")
    made = series.with_scalars(hits(signal_picks(moved, ["sid"]), ["sid"]), real)
    out = made.agg(F.max("hits").alias("hits"), F.avg("h").alias("sur_mean"), F.sum((F.col("h") >= F.col("hits")).cast("int")).alias("as_good"), F.count(F.lit(1)).alias("k_sur"))
    return out.withColumn("p", F.least(F.lit(1.0), (F.col("as_good") + 0.5) / F.col("k_sur")))


def walk_hits(draws: DataFrame, keys: list[str], *, train_n: int = 300, decay: float = 0.99, reds: int = 6) -> DataFrame:
    """(keys, n, hits) of (keys, t, reds) of any length: each draw from train_n on, but for the last, is forecast by the balls that
    weigh most in the train_n draws before it (the newest 1, each step back decay).

    A forecast sees train_n draws only, so stretches that overlap by these are scored apart: the weights of all draws of
    a stretch are one product of its 0/1 matrix with the decays, and a stretch leaves two numbers."""
    last = draws.groupBy(*keys).agg(F.max("t").alias("_last"))
    rows = (draws.join(last, keys) if keys else series.with_scalars(draws, last)).where(F.col("_last") >= train_n + 20)
    rows, stretch = series.reaching(rows.select(*keys, "t", "_last", "reds"), train_n), series.STRETCH

    def scored(table):
        import numpy as np
        import pyarrow as pa

        t = table.column("t").to_numpy()
        order, own, end = np.argsort(t), int(table.column("_s")[0].as_py()), int(table.column("_last")[0].as_py())
        balls = table.column("reds").combine_chunks()
        present = np.zeros((len(t), 33))
        present[np.repeat(np.arange(len(t)), np.diff(balls.offsets.to_numpy())), balls.flatten().to_numpy() - 1] = 1
        t, present = t[order], present[order]
        power = decay ** np.arange(train_n)[::-1]
        n = hits = 0
        for a in range(0, len(t), 512):
            at = np.arange(a, min(a + 512, len(t)))
            at = at[(t[at] // stretch == own) & (t[at] >= train_n) & (t[at] < end)]
            if not len(at):
                continue
            before = present[at[0] - train_n : at[-1]]
            band = np.zeros((len(at), len(before)))
            for i in range(len(at)):
                band[i, i : i + train_n] = power
            top = np.argsort(-np.round(band @ before, 9), 1, kind="stable")[:, :reds]
            n += len(at)
            hits += int(np.take_along_axis(present[at], top, 1).sum())
        own_keys = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table(own_keys | {"n": pa.array([n], pa.int64()), "hits": pa.array([hits], pa.int64())})

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in draws.schema if f.name in keys)
    parts = rows.groupBy(*keys, "_s").applyInArrow(scored, head + "n long, hits long")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def shuffled_walk_hits(draws: DataFrame, k: int, seed: int, *, train_n: int = 300, decay: float = 0.99, reds: int = 6) -> DataFrame:
    """(sid, n, hits): walk_hits() of k shuffles of the draws. The draws, a bit for each ball, are packed into one row, which a few
    tasks share; each makes its own surrogates one at a time, and what leaves it is two numbers for each."""
    bits = F.aggregate("reds", F.lit(0).cast("long"), lambda a, r: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), r - 1)))
    held = statistics.packed(draws.select(F.lit(0).alias("one"), "t", bits.cast("double").alias("x")), ["one"], longest=statistics.PASSES)  # 33 bits: exact as doubles
    rows = held.select("x", F.explode(F.sequence(F.lit(0), F.lit(max(0, min(k, 64) - 1)))).alias("part"))

    def scored(table):
        import numpy as np
        import pyarrow as pa

        part, balls = int(table.column("part")[0].as_py()), 33
        block = 512 if decay >= 1 else max(1, min(512, int(200 / -math.log(decay))))  # weights stay in range
        packed = table.column("x").combine_chunks().flatten().to_numpy().astype(np.int64)
        size, out = len(packed), []
        for sid in range(part, k, min(k, 64)):
            n = hits = 0
            draw = packed[resampling.order_of(size, seed, sid)] if size >= train_n + 21 else packed[:0]
            for a in range(train_n, len(draw) - 1, block):
                z = min(a + block, len(draw) - 1)
                present = draw[a - train_n : z, None] >> np.arange(balls) & 1
                # Weights relative to the block's first draw: a running sum and the one train_n before, turned to each draw's own time.
                sums = np.zeros((len(present) + 1, balls))
                np.cumsum(present * (decay ** (train_n - 1.0 - np.arange(len(present))))[:, None], 0, out=sums[1:])
                score = (sums[train_n:-1] - sums[: z - a]) * (decay ** np.arange(z - a))[:, None]
                # Scores of nine digits, and ties to the smaller ball, as whole numbers.
                key = np.rint(score * 1e9).astype(np.int64) * 64 + (63 - np.arange(balls))
                least = np.partition(key, balls - reds, 1)[:, balls - reds]
                n += z - a
                hits += int(((key >= least[:, None]) & (present[train_n:] > 0)).sum())
            if n:
                out.append((sid, n, hits))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["sid", "n", "hits"])

    return rows.groupBy("part").applyInArrow(scored, "sid int, n long, hits long")


def walk_forward(draws: DataFrame, *, train_n: int = 300, decay: float = 0.99, k: int = 200, seed: int = 0, reds: int = 6, longest: int = statistics.PASSES) -> DataFrame:
    """One row (n, hit_rate, random_rate, sur_mean, p_random, above_random): the hit rate of walk_hits() beside those on k shuffles
    of the draws. Nulls, and no claim, for fewer than train_n + 20 draws. Surrogates are made in tasks from the packed draws, at
    most `longest` of them; those of more draws are shuffled by rows."""
    evaluation.can_reach(k, 0.05)
    knobs = {"train_n": train_n, "decay": decay, "reds": reds}
    rate = F.col("hits") / F.col("n") / reds
    real = walk_hits(draws.select("t", "reds"), [], **knobs).where("n > 0").select("n", rate.alias("hit_rate"))
    if draws.count() <= longest:
        hits = shuffled_walk_hits(draws, k, seed, **knobs)
    else:
        hits = walk_hits(resampling.shuffled(draws.select("t", "reds"), k, seed), ["sid"], **knobs)
    made = hits.select(rate.alias("rate"))
    one = real.agg(F.max("n").alias("n"), F.max("hit_rate").alias("hit_rate"))
    rows = series.with_scalars(made, real).agg(F.avg("rate").alias("sur_mean"), F.sum((F.col("rate") >= F.col("hit_rate")).cast("int")).alias("_as_good"), F.count(F.lit(1)).alias("_k"))
    out = one.crossJoin(F.broadcast(rows))  # a row each
    p = F.when(F.col("n").isNotNull(), (1 + F.coalesce("_as_good", F.lit(0))) / (1 + F.col("_k")))
    out = out.select("n", "hit_rate", F.lit(reds / 33).alias("random_rate"), "sur_mean", p.alias("p_random"))
    return out.withColumn("above_random", F.coalesce((F.col("hit_rate") > F.col("sur_mean")) & (F.col("p_random") < 0.05), F.lit(False)))


# ---- pre-registration


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and those of new whose (issue, method) is not registered yet: a registration is written once."""
    return known.unionByName(new.join(known.select("issue", "method"), ["issue", "method"], "left_anti"))


def score(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """predictions(issue, method, reds, blue) with hits and log losses where the draw (issue, reds, blue) is known."""
    real = actual.select("issue", F.col("reds").alias("actual_reds"), F.col("blue").alias("actual_blue"))
    out = predictions.join(real, "issue", "left")
    return out.withColumn("red_hit", F.size(F.array_intersect("reds", "actual_reds"))).withColumn("blue_hit", (F.col("blue") == F.col("actual_blue")).cast("int")).withColumn("red_loss", log_loss_reds(F.col("reds"), F.col("actual_reds"))).withColumn("blue_loss", log_loss_blue(F.col("blue"), F.col("actual_blue"))).withColumn("red_hit", F.when(F.col("actual_reds").isNotNull(), F.col("red_hit")))


def log_loss_reds(predicted: Column, actual: Column) -> Column:
    """0 if the six balls are the predicted ones, else that of a uniform forecast."""
    return F.when(actual.isNotNull(), F.when(F.size(F.array_except(actual, predicted)) == 0, 0.0).otherwise(LOG_REDS))


def log_loss_blue(predicted: Column, actual: Column) -> Column:
    return F.when(actual.isNotNull(), F.when(predicted == actual, 0.0).otherwise(LOG_BLUE))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n; (0, 0) for n = 0."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p, d = k / m, 1 + z * z / m
    centre, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + half))


def edge(rows: DataFrame, ours: str, base: str, n: str) -> DataFrame:
    """rows with edge, its bounds, z and p_two of two hit counts out of n each, by the pooled proportion."""
    m = F.greatest(F.col(n), F.lit(1)).cast("double")
    pooled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(ours) + F.col(base)) / (2 * m)))
    se = F.sqrt(pooled * (1 - pooled) * 2 / m)
    gap = (F.col(ours) - F.col(base)) / m
    z = F.when(se > 1e-12, gap / F.when(se > 1e-12, se)).otherwise(0.0)
    (o_low, o_high), (b_low, b_high) = wilson(F.col(ours), F.col(n)), wilson(F.col(base), F.col(n))
    return rows.withColumn("edge", gap).withColumn("edge_low", o_low - b_low).withColumn("edge_high", o_high - b_high).withColumn("z", z).withColumn("p_two", 1 - evaluation.erf(F.abs("z") / math.sqrt(2)))


def leaderboard(scored: DataFrame, baseline: str = "random") -> DataFrame:
    """One row for each method of scored(issue, method, red_hit, blue_hit, red_loss, blue_loss): sums, mean hits, and the
    edge of "at least one red" over the baseline's, which counts once for each issue."""
    done = scored.where("red_hit is not null")
    base = done.where(F.col("method") == baseline).select("issue", F.col("red_hit").alias("base_red"), F.col("blue_hit").alias("base_blue"))
    rows = done.where(F.col("method") != baseline).join(base, "issue", "left")
    one = lambda c: F.coalesce((F.col(c) >= 1).cast("int"), F.lit(0))
    out = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("red_hit").alias("red_hits"), F.sum("blue_hit").alias("blue_hits"), F.avg("red_loss").alias("red_loss"), F.avg("blue_loss").alias("blue_loss"), F.avg(F.col("red_hit") - F.coalesce("base_red", F.lit(0))).alias("mean_edge"), F.sum(one("red_hit")).alias("any_red"), F.sum(one("base_red")).alias("base_any_red"))
    return edge(out, "any_red", "base_any_red", "n")


def scored_summary(scored: DataFrame, ours: str, baseline: str = "random") -> DataFrame:
    """One row over the issues that both methods have scored: n, sums and means of hits, and how often ours did no worse."""
    done = scored.where("red_hit is not null")
    one = lambda method, tag: done.where(F.col("method") == method).select("issue", F.col("red_hit").alias(f"{tag}_red"), F.coalesce("blue_hit", F.lit(0)).alias(f"{tag}_blue"))
    rows = one(ours, "our").join(one(baseline, "base"), "issue")
    no_worse = (F.col("our_red") + F.col("our_blue") >= F.col("base_red") + F.col("base_blue")).cast("int")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("our_red").alias("red_hits"), F.avg("our_red").alias("mean_red"), F.sum("base_red").alias("base_red_hits"), F.avg("base_red").alias("base_mean_red"), F.sum("our_blue").alias("blue_hits"), F.sum("base_blue").alias("base_blue_hits"), F.sum(no_worse).alias("no_worse"))
