"""Order-dependent building blocks that never sort a whole table in one task.

A series is (t long, x double) with t dense from 0, or several of them with key columns. Shifts are equi-joins on t + k, or
windows over stretches that overlap by the largest lag. Running sums and fills work in two levels: totals of stretches of t first (few rows), then windows within a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096


def dense_index(df: DataFrame, stretch: Column, order: list[str], name: str = "t", within: Column | None = None) -> DataFrame:
    """df with a dense 0-based rank by `order`, in three levels. Neither stretch, nor within in a stretch, may decrease along
    that order; stretches are few, and `within` parts those that grow with the table."""
    rows = df.withColumn("_s", stretch).withColumn("_w", within if within is not None else F.lit(0))
    small = rows.groupBy("_s", "_w").agg(F.count(F.lit(1)).alias("_n"))
    large = small.groupBy("_s").agg(F.sum("_n").alias("_m"))
    large = large.select("_s", (F.sum("_m").over(Window.orderBy("_s")) - F.col("_m")).alias("_base"))
    small = small.withColumn("_before", F.sum("_n").over(Window.partitionBy("_s").orderBy("_w")) - F.col("_n")).join(large, "_s")
    small = small.select("_s", "_w", (F.col("_base") + F.col("_before")).alias("_base"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_w").orderBy(*order)) - 1)
    return rows.join(small, ["_s", "_w"]).withColumn(name, (F.col("_base") + F.col("_k")).cast("long")).drop("_s", "_w", "_k", "_base")


def with_lags(df: DataFrame, most: int, column: str, name: str = "_lags", keys: list[str] = ()) -> DataFrame:
    """df with name = array of column at t - 1, ..., t - most (null where there is none). t is dense. The last `most` rows of
    each stretch go to the next one too, so a window sees no more than a stretch."""
    rows, own = reaching(df, most, 0), F.floor(F.col("t") / STRETCH)
    w = Window.partitionBy(*keys, "_s").orderBy("t")
    return rows.withColumn(name, F.array(*[F.lag(column, i).over(w) for i in range(1, most + 1)])).where(F.col("_s") == own).drop("_s")


def reaching(df: DataFrame, back: int, ahead: int = 0) -> DataFrame:
    """df with its stretch _s; the last `back` rows of a stretch also go to the next one, the first `ahead` to the one before."""
    if back >= STRETCH or ahead >= STRETCH:
        raise ValueError("shifts must be shorter than a stretch")
    own, place = F.floor(F.col("t") / STRETCH), F.col("t") % STRETCH
    to = F.array(own, F.when(place >= STRETCH - back, own + 1), F.when(place < ahead, own - 1))
    return df.withColumn("_s", F.explode(F.filter(to, lambda s: s.isNotNull())))


def shifted(df: DataFrame, lag: int, column: str, name: str, keys: list[str] = ()) -> DataFrame:
    """df with name = column at t - lag (null where there is none). t is dense; rows without a neighbour in a gap get null."""
    return shifted_all(df, {name: lag}, column, keys)


def shifted_all(df: DataFrame, lags: dict[str, int], column: str, keys: list[str] = ()) -> DataFrame:
    """df with several shifts of a column, by name, from one pass."""
    rows = reaching(df, max(0, *lags.values()), max(0, *(-v for v in lags.values())))
    w = Window.partitionBy(*keys, "_s").orderBy("t")
    for name, lag in lags.items():
        there = F.lag(F.struct(F.col("t").alias("t"), F.col(column).alias("v")), lag).over(w)
        rows = rows.withColumn(name, F.when(there["t"] == F.col("t") - lag, there["v"]))
    return rows.where(F.col("_s") == F.floor(F.col("t") / STRETCH)).drop("_s")


def lagged_pairs(df: DataFrame, lags: list[int], keys: list[str] = (), column: str = "x") -> DataFrame:
    """(keys, lag, t, a, b): b is the value at t and a the one `lag` before. Pairs with a missing value are left out."""
    rows = with_lags(df.select(*keys, "t", column), max(lags), column, "_lags", keys)
    pairs = F.array(*[F.struct(F.lit(i).alias("lag"), F.col("_lags")[i - 1].alias("a")) for i in lags])
    rows = rows.select(*keys, "t", F.col(column).alias("b"), F.explode(pairs).alias("p"))
    return rows.select(*keys, "p.lag", "t", "p.a", "b").where("a is not null and b is not null")


def running(df: DataFrame, column: str, name: str, keys: list[str] = ()) -> DataFrame:
    """df with name = sum of column up to and including t. Sums of stretches are added up within STRETCH of them, and those of
    these parts over all."""
    rows = df.withColumn("_s", F.floor(F.col("t") / STRETCH))
    sums = rows.groupBy(*keys, "_s").agg(F.sum(column).alias("_sum")).withColumn("_u", F.floor(F.col("_s") / STRETCH))
    before = lambda value, order, *part: F.coalesce(F.sum(value).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy(*keys, "_u").agg(F.sum("_sum").alias("_part"))
    parts = parts.select(*keys, "_u", before("_part", "_u", *keys).alias("_far"))
    sums = sums.withColumn("_near", before("_sum", "_s", *keys, "_u")).join(parts, [*keys, "_u"]).select(*keys, "_s", (F.col("_far") + F.col("_near")).alias("_base"))
    inside = Window.partitionBy(*keys, "_s").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum(column).over(inside)).join(sums, [*keys, "_s"])
    return rows.withColumn(name, F.col(name) + F.col("_base")).drop("_s", "_base")


def inpaint(df: DataFrame, column: str = "x") -> DataFrame:
    """Nulls, NaNs and infinities filled by linear interpolation on t; ends held; all missing gives zeros. What is known before
    and after a stretch is carried within STRETCH of them, and from part to part."""
    good = F.when(F.abs(column) < F.lit(float("inf")), F.col(column))
    rows = df.withColumn("_v", good).withColumn("_s", F.floor(F.col("t") / STRETCH)).withColumn("_p", F.when(F.col("_v").isNotNull(), F.struct("t", F.col("_v").alias("v"))))
    ends = rows.groupBy("_s").agg(F.max("_p").alias("hi"), F.min("_p").alias("lo")).withColumn("_u", F.floor(F.col("_s") / STRETCH))

    def carried(table: DataFrame, order: str, *part: str) -> DataFrame:
        w, back = Window.partitionBy(*part).orderBy(order), Window.partitionBy(*part).orderBy(F.desc(order))
        last = F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return table.withColumn("_b", last).withColumn("_a", F.last("lo", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))

    far = carried(ends.groupBy("_u").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")), "_u").select("_u", F.col("_b").alias("_fb"), F.col("_a").alias("_fa"))
    ends = carried(ends, "_s", "_u").join(far, "_u").select("_s", F.coalesce("_b", "_fb").alias("_b"), F.coalesce("_a", "_fa").alias("_a"))
    # A window to the end of its part is made anew for every row; one of the opposite order, up to the row, is not.
    upto = lambda order: F.last("_p", True).over(Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_l", upto(F.col("t"))).withColumn("_r", upto(F.desc("t")))
    rows = rows.join(ends, "_s").withColumn("_l", F.coalesce("_l", "_b")).withColumn("_r", F.coalesce("_r", "_a"))
    share = (F.col("t") - F.col("_l.t")) / F.nullif(F.col("_r.t") - F.col("_l.t"), F.lit(0))
    between = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * F.coalesce(share, F.lit(0.0))
    return rows.withColumn(column, F.coalesce(between, F.col("_l.v"), F.col("_r.v"), F.lit(0.0))).drop("_v", "_s", "_p", "_l", "_r", "_a", "_b")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """df beside the one row of scalars (an aggregate without keys), which is broadcast."""
    return df.join(F.broadcast(scalars.limit(1).withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")


def reordered(df: DataFrame, mode: str, n: int, seed: int = 0) -> DataFrame:
    """Draws or a series with t permuted: identity, reverse, block (reverse within blocks of side max(2, floor(sqrt n))) or shuffle."""
    t = F.col("t")
    if mode == "reverse":
        return df.withColumn("t", F.lit(n - 1) - t)
    if mode == "block":
        side = max(2, int(n**0.5))
        start = F.floor(t / side) * side
        return df.withColumn("t", start + F.least(start + side, F.lit(n)) - 1 - t)
    if mode == "shuffle":
        from .resampling import shuffled

        return shuffled(df, 1, seed).drop("sid")
    return df
