"""Signals: what a draw (reds array<int> of six sorted balls, blue int) says as one number.

Row-local signals are Column builders in SIGNALS; those that look at other draws are functions of the whole table in
SERIES. Both give double.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.operators import series

# The primes among the balls 1..33.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def gaps(reds: Column) -> Column:
    """Differences of neighbouring balls."""
    return F.transform(F.sequence(F.lit(2), F.lit(6)), lambda i: F.element_at(reds, i) - F.element_at(reds, i - 1))


def gap_powers(reds: Column) -> list[Column]:
    """Sums of the gaps, of their squares and of their cubes, as whole numbers. No array is built, so Spark compiles them."""
    own = [F.element_at(reds, i) - F.element_at(reds, i - 1) for i in range(2, 7)]
    return [sum((_power(g, p) for g in own[1:]), _power(own[0], p)) for p in (1, 2, 3)]


def _power(g: Column, p: int) -> Column:
    return g if p == 1 else g * _power(g, p - 1)


def gap_spread(reds: Column) -> Column:
    """Population standard deviation of the gaps."""
    one, two, _ = gap_powers(reds)
    return F.sqrt((5 * two - one * one) / F.lit(25.0))


def turned(values: Column, div: float, part) -> Column:
    """Sum of the balls' cosines or sines on a circle of div. Those of the balls 1..33 are constants, by the C library as in
    SQL: vectors that cancel leave only roundings, of which an angle is then made."""
    own = {F.cos: math.cos, F.sin: math.sin}[part]
    known = F.lit([own(r * 2 * math.pi / div) for r in range(1, 34)])
    return total(F.transform(values, lambda r: F.coalesce(F.get(known, r - 1), part(r * F.lit(2) * F.lit(math.pi) / F.lit(float(div))))))


def length_of(values: Column, div: float) -> Column:
    return F.sqrt(F.pow(turned(values, div, F.cos), F.lit(2.0)) + F.pow(turned(values, div, F.sin), F.lit(2.0)))


def _count(reds, test) -> Column:
    return F.size(F.filter(reds, test)).cast("double")


def _sum_mod(m: int):
    return lambda r, b: F.pmod(total(r), F.lit(float(m)))


def _runs(r: Column) -> Column:
    changes = F.filter(F.sequence(F.lit(1), F.lit(32)), lambda i: F.array_contains(r, i) != F.array_contains(r, i + 1))
    return F.size(changes) + 1.0


def _zone_entropy(r: Column) -> Column:
    zone = lambda x: F.floor((x - 1) / 3)
    return -total(F.transform(r, lambda x: F.ln(F.size(F.filter(r, lambda y: zone(y) == zone(x))) / 6.0) / 6.0))


def _skew(r: Column) -> Column:
    one, two, three = gap_powers(r)
    return (25 * three - 15 * one * two + 2 * one * one * one) / F.lit(125.0) / F.pow(gap_spread(r) + 1e-9, F.lit(3.0))


SIGNALS = {
    "red_sum": lambda r, b: total(r),
    "red_mean": lambda r, b: mean(r),
    "red_energy": lambda r, b: total(F.transform(r, lambda x: x * x)),
    "red_weighted": lambda r, b: total(F.transform(r, lambda x, i: x * (i + 1))),
    "red_span": lambda r, b: (F.array_max(r) - F.array_min(r)).cast("double"),
    "red_delta_mean": lambda r, b: mean(gaps(r)),
    "red_parity": lambda r, b: _count(r, lambda x: x % 2 == 1),
    "blue": lambda r, b: b.cast("double"),
    "vector_mag": lambda r, b, div=33: length_of(r, div),
    "vector_phase": lambda r, b, div=33: F.atan2(turned(r, div, F.sin), turned(r, div, F.cos)),
    "complex_field": lambda r, b, div=34: length_of(F.concat(r, F.array(b)), div),
    "red_gap_mean": lambda r, b: mean(gaps(r)),
    "red_gap_max": lambda r, b: F.array_max(gaps(r)).cast("double"),
    "red_gap_std": lambda r, b: gap_spread(r),
    "red_runs": lambda r, b: _runs(r),
    "red_low_count": lambda r, b: _count(r, lambda x: x <= 16),
    "red_zone_entropy": lambda r, b: _zone_entropy(r),
    "red_consecutive": lambda r, b: _count(gaps(r), lambda g: g == 1),
    "red_sum_mod11": _sum_mod(11),
    "red_sum_mod16": _sum_mod(16),
    "red_prime_count": lambda r, b: _count(r, lambda x: x.isin(*PRIMES)),
    "blue_resid": lambda r, b: b - F.pmod(total(r), F.lit(16.0)),
    "red_sum_mod3": _sum_mod(3),
    "red_sum_mod7": _sum_mod(7),
    "red_sum_mod31": _sum_mod(31),
    "red_prod_mod33": lambda r, b: F.aggregate(r, F.lit(1), lambda a, x: (a * x) % 33).cast("double"),
    "red_pair_meandist": lambda r, b: mean(gaps(r)),
    "red_centroid": lambda r, b: mean(r) / 17.0 - 1.0,
    "lp_red_gap_skew": lambda r, b: _skew(r),
    "lp_red_pair_corr_max": lambda r, b: F.pmod(total(gaps(r)), F.lit(33.0)),
    "predict_gap_max": lambda r, b: F.greatest(F.array_max(gaps(r)), F.array_min(r) + 33 - F.array_max(r)).cast("double"),
}


def column(name: str, **knobs) -> Column:
    """The signal over columns reds and blue."""
    return SIGNALS[name](F.col("reds"), F.col("blue"), **knobs).cast("double")


def wide(draws: DataFrame, names=None) -> DataFrame:
    """One column for each row-local signal."""
    return draws.select("t", *[column(n).alias(n) for n in names or SIGNALS])


def long(draws: DataFrame, names) -> DataFrame:
    """(series_id, t, x) of several signals from one pass over the draws."""
    return draws.select("t", F.explode(F.array(*[F.struct(F.lit(n).alias("series_id"), column(n).alias("x")) for n in names])).alias("s")).select("s.series_id", "t", "s.x")


def recurrence_mean(draws: DataFrame) -> DataFrame:
    """Mean over a draw's balls of the draws since the ball was last seen; never seen counts as N. A ball's last appearance
    before each stretch is found first (few rows), then windows look within a stretch, so no ball's draws meet in a task."""
    n = draws.agg(F.count(F.lit(1)).alias("n"))
    balls = draws.select("t", F.explode("reds").alias("ball")).withColumn("s", F.floor(F.col("t") / series.STRETCH))
    ends = balls.groupBy("ball", "s").agg(F.max("t").alias("end"))
    before = Window.partitionBy("ball").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("ball", "s", F.max("end").over(before).alias("carried"))
    inside = F.lag("t").over(Window.partitionBy("ball", "s").orderBy("t"))
    since = balls.withColumn("inside", inside).join(ends, ["ball", "s"]).select("t", (F.col("t") - F.coalesce("inside", "carried")).alias("since"))
    return series.with_scalars(since, n).groupBy("t").agg(F.avg(F.coalesce("since", "n")).alias("x"))


def sum_reversed(draws: DataFrame, n: int) -> DataFrame:
    return series.reordered(draws.select("t", column("red_sum").alias("x")), "reverse", n)


def sum_in_blocks(draws: DataFrame, n: int) -> DataFrame:
    return series.reordered(draws.select("t", column("red_sum").alias("x")), "block", n)


def centroid_velocity(draws: DataFrame) -> DataFrame:
    rows = series.shifted(draws.select("t", column("red_mean").alias("v")), 1, "v", "before")
    return rows.select("t", F.coalesce(F.col("v") - F.col("before"), F.lit(0.0)).alias("x"))


def blue_resid_autocorr(draws: DataFrame) -> DataFrame:
    rows = draws.select("t", (F.col("blue") - column("red_mean") / 33.0).alias("e"))
    rows = series.with_scalars(rows, rows.agg(F.avg("e").alias("m"))).select("t", (F.col("e") - F.col("m")).alias("e"))
    return series.shifted(rows, 1, "e", "before").select("t", F.coalesce(F.col("e") * F.col("before"), F.lit(0.0)).alias("x"))


def entropy_rate(draws: DataFrame) -> DataFrame:
    """Mean gap less its mean over all draws, times the entropy of the mean gap in ten bins from -16 to 16."""
    rows = draws.select("t", column("red_gap_mean").alias("g"))
    bins = rows.groupBy(F.least(F.floor((F.col("g") + 16) / 3.2), F.lit(10)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum("g").alias("s"))
    one = bins.agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("m"), F.collect_list("c").alias("cs"))
    p = lambda c, n: c / (n + 1e-9)
    ent = -F.aggregate("cs", F.lit(0.0), lambda a, c: a + p(c, F.col("n")) * F.ln(p(c, F.col("n"))))
    return series.with_scalars(rows, one.select("m", ent.alias("ent"))).select("t", ((F.col("g") - F.col("m")) * (F.col("ent") + 1e-9)).alias("x"))


def presence(draws: DataFrame) -> DataFrame:
    """(colour, ball, t, y): 1 where the ball is drawn."""
    ball = F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.lit(33)), lambda b: F.struct(F.lit("red").alias("colour"), b.alias("ball"), F.array_contains("reds", b).cast("int").alias("y"))), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda b: F.struct(F.lit("blue").alias("colour"), b.alias("ball"), (F.col("blue") == b).cast("int").alias("y")))))
    return draws.select("t", ball.alias("p")).select("p.colour", "p.ball", "t", "p.y")


def presence_of(draws: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, colour, ball) of the balls that were drawn: seven rows for each draw."""
    ball = F.explode(F.concat(F.transform("reds", lambda r: F.struct(F.lit("red").alias("colour"), r.alias("ball"))), F.array(F.struct(F.lit("blue").alias("colour"), F.col("blue").alias("ball")))))
    return draws.select(*keys, "t", ball.alias("b")).select(*keys, "t", "b.colour", "b.ball")


SERIES = {"red_recurrence_mean": recurrence_mean, "lp_red_centroid_velocity": centroid_velocity, "lp_blue_resid_autocorr": blue_resid_autocorr, "lp_red_entropy_rate": entropy_rate, "red_sum_rev": lambda d: sum_reversed(d, d.count()), "red_sum_block": lambda d: sum_in_blocks(d, d.count())}

# Families of signals, for diversity among elites; a signal not named here is of the family "other".
FAMILIES = {
    "red_sum": "sum_energy", "red_sum_rev": "sum_energy", "red_sum_block": "sum_energy", "red_energy": "sum_energy",
    "red_mean": "mean", "red_weighted": "mean", "red_span": "span", "red_delta_mean": "delta",
    "red_gap_mean": "gap", "red_gap_max": "gap", "red_gap_std": "gap",
    "red_runs": "runs", "red_low_count": "count", "red_prime_count": "count", "red_zone_entropy": "entropy",
    "red_recurrence_mean": "recurrence", "red_consecutive": "recurrence", "blue": "blue", "blue_resid": "blue",
    "vector_mag": "vector", "vector_phase": "vector", "complex_field": "vector", "red_parity": "parity",
    "red_sum_mod11": "mod", "red_sum_mod16": "mod",
}


def family(sig: str, first: str | None = None) -> str:
    """The family of a signal; of a formula that of its first operand."""
    return f"comp:{FAMILIES.get(first or '', 'other')}" if sig == "comp" else FAMILIES.get(sig, "other")
