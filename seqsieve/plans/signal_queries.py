"""Queries over signals, formulas and statistics, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from seqsieve.functions import formula, signals
from seqsieve.operators import neighbours, resampling, series, spectrum, statistics
from seqsieve.sources.draws import derived, table

QUERIES, ORACLES = {}, {}

DRAWS = """draws AS (
  SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS t, o_orderkey AS issue, b[1:6] AS reds, CAST(1 + o_custkey % 16 AS INTEGER) AS blue
  FROM (SELECT l_orderkey, list_sort(list(DISTINCT CAST(1 + l_partkey % 33 AS INTEGER))) AS b FROM lineitem GROUP BY l_orderkey)
  JOIN orders ON o_orderkey = l_orderkey WHERE len(b) >= 6)"""
SUM = "CAST(list_sum(reds) AS DOUBLE)"
GAPS = "list_transform(range(2, 7), lambda i: CAST(reds[i] - reds[i - 1] AS DOUBLE))"
X = f"{DRAWS}, s AS (SELECT t, {SUM} AS x FROM draws)"
#: Each user's events in order of time as a series of values.
USERS = """s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value AS x FROM events)"""


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def wide(spark, sf_dir, names):
    return derived(spark, sf_dir).select("t", *[r6(signals.column(n)).alias(n) for n in names])


def wide_sql(columns: dict[str, str], inner: str = "") -> str:
    return f"WITH {DRAWS}{inner} SELECT t, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}" for k, v in columns.items()) + f" FROM {'g' if inner else 'draws'}"


def sums(spark, sf_dir):
    return derived(spark, sf_dir).select("t", signals.column("red_sum").alias("x"))


def user_series(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("value").alias("x"))


@register(f"WITH {DRAWS} SELECT t, issue, reds[1] AS r1, reds[2] AS r2, reds[3] AS r3, reds[4] AS r4, reds[5] AS r5, reds[6] AS r6, blue FROM draws")
def draws(spark, sf_dir):
    return derived(spark, sf_dir).select("t", "issue", *[F.element_at("reds", i).alias(f"r{i}") for i in range(1, 7)], "blue")


@register(wide_sql({"red_sum": SUM, "red_mean": "list_avg(reds)", "red_energy": "list_sum(list_transform(reds, lambda x: x * x))", "red_weighted": "list_sum(list_transform(range(1, 7), lambda i: reds[i] * i))", "red_span": "reds[6] - reds[1]", "red_parity": "len(list_filter(reds, lambda x: x % 2 = 1))", "blue": "blue", "red_centroid": "list_avg(reds) / 17.0 - 1"}))
def sig_level(spark, sf_dir):
    return wide(spark, sf_dir, ["red_sum", "red_mean", "red_energy", "red_weighted", "red_span", "red_parity", "blue", "red_centroid"])


def _vec(part: str, nums: str, div: int) -> str:
    return f"list_sum(list_transform({nums}, lambda r: {part}(r * 2 * pi() / {div})))"


@register(wide_sql({"vector_mag": f"sqrt({_vec('cos', 'reds', 33)}^2 + {_vec('sin', 'reds', 33)}^2)", "vector_phase": f"atan2({_vec('sin', 'reds', 33)}, {_vec('cos', 'reds', 33)})", "complex_field": f"sqrt({_vec('cos', 'list_append(reds, blue)', 34)}^2 + {_vec('sin', 'list_append(reds, blue)', 34)}^2)"}))
def sig_vector(spark, sf_dir):
    return wide(spark, sf_dir, ["vector_mag", "vector_phase", "complex_field"])


@register(
    wide_sql(
        {"red_delta_mean": "list_avg(g)", "red_gap_mean": "list_avg(g)", "red_gap_max": "list_max(g)", "red_gap_std": "list_stddev_pop(g)", "red_consecutive": "len(list_filter(g, lambda v: v = 1))", "red_pair_meandist": "list_avg(g)", "lp_red_gap_skew": "list_avg(list_transform(g, lambda v: ((v - list_avg(g)) / (list_stddev_pop(g) + 1e-9))^3))", "lp_red_pair_corr_max": "list_sum(g) % 33", "predict_gap_max": "greatest(list_max(g), reds[1] + 33 - reds[6])"},
        f", g AS (SELECT t, reds, {GAPS} AS g FROM draws)",
    )
)
def sig_gap(spark, sf_dir):
    return wide(spark, sf_dir, ["red_delta_mean", "red_gap_mean", "red_gap_max", "red_gap_std", "red_consecutive", "red_pair_meandist", "lp_red_gap_skew", "lp_red_pair_corr_max", "predict_gap_max"])


@register(wide_sql({"red_runs": "1 + len(list_filter(range(1, 33), lambda i: list_contains(reds, i) <> list_contains(reds, i + 1)))", "red_low_count": "len(list_filter(reds, lambda x: x <= 16))", "red_zone_entropy": "-list_sum(list_transform(reds, lambda x: ln(len(list_filter(reds, lambda y: (y - 1) // 3 = (x - 1) // 3)) / 6.0) / 6))", "red_prime_count": f"len(list_filter(reds, lambda x: x IN {signals.PRIMES}))"}))
def sig_count(spark, sf_dir):
    return wide(spark, sf_dir, ["red_runs", "red_low_count", "red_zone_entropy", "red_prime_count"])


@register(wide_sql({"red_sum_mod11": f"{SUM} % 11", "red_sum_mod16": f"{SUM} % 16", "blue_resid": f"blue - {SUM} % 16", "red_sum_mod3": f"{SUM} % 3", "red_sum_mod7": f"{SUM} % 7", "red_sum_mod31": f"{SUM} % 31", "red_prod_mod33": "list_reduce(reds, lambda a, x: (a * x) % 33, 1)"}))
def sig_modular(spark, sf_dir):
    return wide(spark, sf_dir, ["red_sum_mod11", "red_sum_mod16", "blue_resid", "red_sum_mod3", "red_sum_mod7", "red_sum_mod31", "red_prod_mod33"])


@register(f"WITH {DRAWS}, e AS (SELECT t, unnest(reds) AS ball FROM draws), g AS (SELECT t, coalesce(t - lag(t) OVER (PARTITION BY ball ORDER BY t), (SELECT count(*) FROM draws)) AS since FROM e) SELECT t, round(avg(since), 6) AS x FROM g GROUP BY t")
def sig_recurrence(spark, sf_dir):
    return signals.recurrence_mean(derived(spark, sf_dir)).select("t", r6(F.col("x")).alias("x"))


@register(f"WITH {X} SELECT (SELECT max(t) FROM s) - t AS t, x FROM s")
def sig_reversed(spark, sf_dir):
    d = derived(spark, sf_dir)
    return signals.sum_reversed(d, d.count()).select("t", "x")


@register(f"WITH {X}, k AS (SELECT count(*) AS n, greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT)) AS side FROM s) SELECT CAST((t // side) * side + least((t // side) * side + side, n) - 1 - t AS BIGINT) AS t, x FROM s, k")
def sig_block(spark, sf_dir):
    d = derived(spark, sf_dir)
    return signals.sum_in_blocks(d, d.count()).select(F.col("t").cast("long").alias("t"), "x")


@register(f"WITH {DRAWS}, m AS (SELECT t, list_avg(reds) AS v FROM draws) SELECT t, round(coalesce(v - lag(v) OVER (ORDER BY t), 0), 6) + 0.0 AS x FROM m")
def sig_centroid_velocity(spark, sf_dir):
    return signals.centroid_velocity(derived(spark, sf_dir)).select("t", r6(F.col("x")).alias("x"))


@register(f"WITH {DRAWS}, e AS (SELECT t, blue - list_avg(reds) / 33.0 AS e FROM draws), c AS (SELECT t, e - avg(e) OVER () AS e FROM e) SELECT t, round(coalesce(e * lag(e) OVER (ORDER BY t), 0), 6) + 0.0 AS x FROM c")
def sig_blue_autocorr(spark, sf_dir):
    return signals.blue_resid_autocorr(derived(spark, sf_dir)).select("t", r6(F.col("x")).alias("x"))


@register(f"WITH {DRAWS}, g AS (SELECT t, list_avg({GAPS}) AS g FROM draws), b AS (SELECT count(*) / ((SELECT count(*) FROM g) + 1e-9) AS p FROM g GROUP BY least(floor((g + 16) / 3.2), 10)), e AS (SELECT -sum(p * ln(p)) AS ent FROM b) SELECT t, round((g - avg(g) OVER ()) * ((SELECT ent FROM e) + 1e-9), 6) + 0.0 AS x FROM g")
def sig_entropy_rate(spark, sf_dir):
    return signals.entropy_rate(derived(spark, sf_dir)).select("t", r6(F.col("x")).alias("x"))


@register(f"WITH {DRAWS}, b AS (SELECT 'red' AS colour, unnest(range(1, 34)) AS ball UNION ALL SELECT 'blue', unnest(range(1, 17))) SELECT colour, CAST(ball AS INTEGER) AS ball, CAST(sum(y) AS BIGINT) AS present, count(*) AS n, CAST(coalesce(sum(t * y), 0) AS BIGINT) AS t_sum FROM (SELECT colour, ball, t, CASE WHEN colour = 'red' THEN list_contains(reds, ball) ELSE blue = ball END::INTEGER AS y FROM b, draws) GROUP BY colour, ball")
def presence33(spark, sf_dir):
    p = signals.presence(derived(spark, sf_dir))
    return p.groupBy("colour", "ball").agg(F.sum("y").alias("present"), F.count(F.lit(1)).alias("n"), F.sum(F.col("t") * F.col("y")).alias("t_sum"))


# ---- formulas

_A, _B = SUM, "CAST(blue AS DOUBLE)"
AB = f"{DRAWS}, s AS (SELECT t, {_A} AS a, {_B} AS b FROM draws)"


def _formula(name: str, f: dict, sql: str) -> None:
    def run(spark, sf_dir):
        return formula.evaluate(derived(spark, sf_dir), f).select("t", r6(F.col("x")).alias("x"))

    run.__name__ = name
    register(f"WITH {AB} SELECT t, round({sql}, 6) + 0.0 AS x FROM s")(run)


_formula("comp_add", {"op": "+", "a": "red_sum", "b": "blue"}, "a + b")
_formula("comp_sub", {"op": "-", "a": "red_sum", "b": "blue"}, "a - b")
_formula("comp_mul", {"op": "*", "a": "red_sum", "b": "blue"}, "a * b")
_formula("comp_div", {"op": "/", "a": "red_sum", "b": "red_consecutive"}, "CASE WHEN c = 0 THEN 0 ELSE a / c END")
ORACLES["comp_div"] = f"WITH {DRAWS}, s AS (SELECT t, {_A} AS a, len(list_filter({GAPS}, lambda v: v = 1)) AS c FROM draws) SELECT t, round(CASE WHEN c = 0 THEN 0 ELSE a / c END, 6) + 0.0 AS x FROM s"
_formula("comp_diff", {"op": "diff", "a": "red_sum"}, "coalesce(a - lag(a) OVER (ORDER BY t), lead(a) OVER (ORDER BY t) - a)")
_formula("comp_z", {"op": "z", "a": "red_sum"}, "(a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-12)")
_formula("comp_lag", {"op": "lag", "a": "red_sum", "k": 3}, "coalesce(lag(a, 3) OVER (ORDER BY t), (SELECT a FROM s WHERE t = 0))")
_formula("comp_pow", {"op": "pow", "a": "blue_resid", "b": "red_centroid"}, "")
ORACLES["comp_pow"] = f"WITH {DRAWS}, s AS (SELECT t, blue - {SUM} % 16 AS a, list_avg(reds) / 17.0 - 1 AS b FROM draws) SELECT t, round(sign(a) * pow(abs(a), abs(greatest(-3, least(3, b)))), 6) + 0.0 AS x FROM s"
_formula("comp_thresh", {"op": "thresh", "a": "red_sum"}, "a - median(a) OVER ()")
_formula("comp_sin", {"op": "sin", "a": "red_sum"}, "sin(a)")
_formula("comp_cos", {"op": "cos", "a": "red_sum"}, "cos(a)")
_formula("comp_abs", {"op": "abs", "a": "blue_resid"}, "")
ORACLES["comp_abs"] = f"WITH {DRAWS} SELECT t, round(abs(blue - {SUM} % 16), 6) AS x FROM draws"
_formula("nested_comp", {"op": "-", "a": {"op": "lag", "a": "red_sum", "k": 2}, "b": {"op": "/", "a": "blue", "b": "red_span"}}, "")
ORACLES["nested_comp"] = f"""WITH {DRAWS}, s AS (SELECT t, lag({SUM}, 2) OVER (ORDER BY t) - blue / CAST(reds[6] - reds[1] AS DOUBLE) AS x FROM draws)
  SELECT t, round(coalesce(x, (SELECT x FROM s WHERE t = 2)), 6) + 0.0 AS x FROM s"""


@register(
    f"""WITH {DRAWS}, s AS (SELECT t, CASE WHEN blue <= 10 THEN {SUM} END AS v FROM draws),
  e AS (SELECT t, v, max(CASE WHEN v IS NOT NULL THEN t END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS lt, min(CASE WHEN v IS NOT NULL THEN t END) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rt FROM s)
  SELECT e.t, round(CASE WHEN l.v IS NULL THEN r.v WHEN r.v IS NULL OR l.t = r.t THEN l.v ELSE l.v + (r.v - l.v) * (e.t - l.t) / (r.t - l.t) END, 6) AS x
  FROM e LEFT JOIN s l ON l.t = e.lt LEFT JOIN s r ON r.t = e.rt"""
)
def inpaint(spark, sf_dir):
    rows = derived(spark, sf_dir).select("t", F.when(F.col("blue") <= 10, signals.column("red_sum")).alias("x"))
    return series.inpaint(rows).select("t", r6(F.col("x")).alias("x"))


@register(f"WITH {X} SELECT CAST(row_number() OVER (ORDER BY md5('7:0:' || t)) - 1 AS BIGINT) AS t, x FROM s")
def reorder_shuffle(spark, sf_dir):
    return series.reordered(sums(spark, sf_dir), "shuffle", 0, seed=7).select("t", "x")


@register(
    f"""WITH {X}, f AS (SELECT t, x, lead(x) OVER w AS nx, lag(x) OVER w AS px, lag(x, 2) OVER w AS ox, avg(x) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS m FROM s WINDOW w AS (ORDER BY t))
  SELECT t, CAST(sign(nx - x) AS DOUBLE) AS actual, CAST(coalesce(sign(x - px), 0) AS DOUBLE) + 0.0 AS cont, CAST(coalesce(-sign(x - px), 0) AS DOUBLE) + 0.0 AS rev,
         CASE WHEN t >= 1 THEN CAST(sign(round(x - m, 9)) AS DOUBLE) ELSE 0.0 END AS mean, CAST(coalesce(sign(x - ox), 0) AS DOUBLE) AS osc FROM f WHERE nx IS NOT NULL"""
)
def reading_rules(spark, sf_dir):
    return formula.forecasts(sums(spark, sf_dir), 2).select("t", "actual", "cont", (F.col("rev") + 0.0).alias("rev"), "mean", "osc")


# ---- statistics


def _one(df):
    return df.select(r6(F.col("stat")).alias("stat"))


def keyed(rows):
    return rows.withColumn("series_id", F.lit("red_sum"))


@register(
    f"""WITH {X}, c AS (SELECT t, x - avg(x) OVER () AS x, count(*) OVER () AS n FROM s),
  p AS (SELECT k, sum(x * cos(2 * pi() * k * t / n))^2 + sum(x * sin(2 * pi() * k * t / n))^2 AS p FROM c, range(0, (SELECT count(*) // 2 + 1 FROM s)) r(k) GROUP BY k)
  SELECT round(max(CASE WHEN k > 0 THEN p END) / sum(p), 6) AS stat FROM p"""
)
def fft_peak(spark, sf_dir):
    return _one(spectrum.fft_peak(keyed(sums(spark, sf_dir)), ["series_id"]))


@register(f"WITH {X}, p AS (SELECT l, corr(a.x, b.x) AS c FROM range(1, 41) r(l), s a JOIN s b ON b.t = a.t + l GROUP BY l) SELECT round(max(abs(c)), 6) AS stat FROM p")
def acf_max(spark, sf_dir):
    return _one(statistics.acf_max(keyed(sums(spark, sf_dir)), ["series_id"], 40))


@register(
    f"""WITH {X}, y AS (SELECT t, sum(x - m) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS y, n FROM (SELECT t, x, avg(x) OVER () AS m, count(*) OVER () AS n FROM s)),
  sc AS (SELECT DISTINCT CAST(floor(pow(10, 1 + i * (log10(greatest(11, n // 4)) - 1) / 19)+1e-9) AS BIGINT) AS s, n FROM range(0, 20) r(i), (SELECT count(*) AS n FROM s)),
  g AS (SELECT s, t // s AS seg, sqrt(greatest(0, var_pop(y) * (1 - coalesce(corr(y, t), 0)^2))) AS rms FROM y, sc WHERE sc.n // s >= 4 AND t < sc.n // s * s GROUP BY s, t // s),
  f AS (SELECT s, avg(rms) AS f FROM g GROUP BY s) SELECT round(regr_slope(log10(f), log10(s)), 6) AS stat FROM f"""
)
def dfa_alpha(spark, sf_dir):
    return _one(statistics.dfa_alpha(keyed(sums(spark, sf_dir)), ["series_id"]))


@register(
    f"""WITH {X}, p AS (SELECT l, a.x AS a, b.x AS b FROM range(1, 21) r(l), s a JOIN s b ON b.t = a.t + l),
  c AS (SELECT l, least(11, floor((a - a0) / (a1 - a0) * 12)) AS i, least(11, floor((b - b0) / (b1 - b0) * 12)) AS j, count(*) AS c
        FROM (SELECT *, min(a) OVER w AS a0, max(a) OVER w AS a1, min(b) OVER w AS b0, max(b) OVER w AS b1 FROM p WINDOW w AS (PARTITION BY l)) GROUP BY ALL),
  m AS (SELECT l, c / sum(c) OVER (PARTITION BY l) * log2(c * sum(c) OVER (PARTITION BY l) / (sum(c) OVER (PARTITION BY l, i) * sum(c) OVER (PARTITION BY l, j))) AS m FROM c)
  SELECT round(max(mi), 6) AS stat FROM (SELECT sum(m) AS mi FROM m GROUP BY l)"""
)
def mi_max(spark, sf_dir):
    return _one(statistics.mi_max(keyed(sums(spark, sf_dir)), ["series_id"]))


@register(
    f"""WITH {X}, w AS (SELECT x AS a, lead(x) OVER (ORDER BY t) AS b, lead(x, 2) OVER (ORDER BY t) AS c FROM s WHERE t < 2000),
  p AS (SELECT (a <= b)::INT AS ab, (a <= c)::INT AS ac, (b <= c)::INT AS bc, count(*) AS c FROM w WHERE c IS NOT NULL GROUP BY ALL)
  SELECT round(-sum(c / n * ln(c / n)), 6) AS stat FROM p, (SELECT sum(c) AS n FROM p)"""
)
def perm_entropy(spark, sf_dir):
    return _one(statistics.perm_entropy(keyed(sums(spark, sf_dir)), ["series_id"], sub=2000))


_SUB = f"{X}, u AS (SELECT t, x FROM s WHERE t < {{sub}}), r AS (SELECT {{f}} * (stddev_pop(x) + 1e-12) AS r, count(*) AS n FROM u)"


@register(
    f"""WITH {_SUB.format(sub=600, f=0.1)}, c AS (SELECT a.t AS i, b.t - a.t AS d FROM u a JOIN u b ON a.t <= b.t, r WHERE abs(a.x - b.x) <= r.r),
  h AS (SELECT d, i, lag(i) OVER (PARTITION BY d ORDER BY i) AS p, lead(i) OVER (PARTITION BY d ORDER BY i) AS q FROM c WHERE d > 0)
  SELECT round((SELECT count(*) FROM h WHERE p = i - 1 OR q = i + 1) / (SELECT sum(CASE WHEN d = 0 THEN 1 ELSE 2 END) FROM c)::DOUBLE, 6) AS stat"""
)
def rq_determinism(spark, sf_dir):
    return _one(statistics.measure(statistics.packed(keyed(sums(spark, sf_dir)).where("t < 600"), ["series_id"]), "rq_determinism", ["series_id"]))


def _template_sql(self_match: bool) -> str:
    less, div = ("", "(n - {k} + 1)") if self_match else (" - 1 + 1e-12", "(n - {k})")
    part = lambda k, cond: f"p{k} AS (SELECT avg(ln((c{less}) / {div.format(k=k)})) AS phi FROM (SELECT a.t, count(*) AS c, max(a.n) AS n FROM v a JOIN v b ON abs(a.x - b.x) <= a.r AND abs(a.y - b.y) <= a.r{cond} WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY a.t))"
    three = " AND abs(a.z - b.z) <= a.r AND a.z IS NOT NULL AND b.z IS NOT NULL"
    return f"WITH {_SUB.format(sub=1200, f=0.2)}, v AS (SELECT t, x, lead(x) OVER (ORDER BY t) AS y, lead(x, 2) OVER (ORDER BY t) AS z, r, n FROM u, r), {part(2, '')}, {part(3, three)} SELECT round(p2.phi - p3.phi, 6) AS stat FROM p2, p3"


@register(_template_sql(True))
def approx_entropy(spark, sf_dir):
    return _one(statistics.measure(statistics.packed(keyed(sums(spark, sf_dir)).where("t < 1200"), ["series_id"]), "approx_entropy", ["series_id"]))


@register(_template_sql(False))
def sample_entropy(spark, sf_dir):
    return _one(statistics.measure(statistics.packed(keyed(sums(spark, sf_dir)).where("t < 1200"), ["series_id"]), "sample_entropy", ["series_id"]))


def _heavy(name: str):
    def run(spark, sf_dir):
        rows = statistics.packed(signals.long(derived(spark, sf_dir), ["red_sum", "blue", "red_gap_max", "vector_mag"]), ["series_id"], longest=statistics.PASSES)
        return statistics.measure(rows, name, ["series_id"], sub=1200).select("series_id", r6(F.col("stat")).alias("stat"))

    run.__name__ = name
    register()(run)


_heavy("multiscale_se")
_heavy("corr_dim_slope")
_FOUR = f"""{DRAWS}, s AS (SELECT t, unnest([struct_pack(series_id := 'red_sum', x := {SUM}), struct_pack(series_id := 'blue', x := CAST(blue AS DOUBLE)), struct_pack(series_id := 'red_gap_max', x := list_max({GAPS})),
    struct_pack(series_id := 'vector_mag', x := sqrt({_vec('cos', 'reds', 33)}^2 + {_vec('sin', 'reds', 33)}^2))], recursive := true) FROM draws)"""
# Windows of two and three coarse values that lie within r of one another in every place.
ORACLES["multiscale_se"] = f"""WITH {_FOUR}, u AS (SELECT series_id, t, x FROM s WHERE t < 1200), k AS (SELECT series_id, .2 * (stddev_pop(x) + 1e-12) AS r, count(*) AS n FROM u GROUP BY series_id),
  c AS (SELECT series_id, tau, t // tau AS i, avg(x) AS x, n // tau AS n, r FROM u JOIN k USING (series_id), range(1, 6) q(tau) WHERE t < n // tau * tau GROUP BY ALL),
  w AS (SELECT series_id, tau, i, n, r, x, lead(x) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM c WINDOW o AS (PARTITION BY series_id, tau ORDER BY i)),
  m AS (SELECT a.series_id, a.tau, a.i, a.n, count(*) FILTER (abs(a.x - b.x) <= a.r AND abs(a.x1 - b.x1) <= a.r) AS two, count(*) FILTER (abs(a.x - b.x) <= a.r AND abs(a.x1 - b.x1) <= a.r AND abs(a.x2 - b.x2) <= a.r) AS three, a.x2 IS NOT NULL AS long
        FROM w a JOIN w b ON a.series_id = b.series_id AND a.tau = b.tau WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL GROUP BY ALL),
  e AS (SELECT series_id, tau, avg(ln((two - 1 + 1e-12) / (n - 2))) - avg(CASE WHEN long THEN ln((three - 1 + 1e-12) / (n - 3)) END) AS se FROM m GROUP BY series_id, tau)
  SELECT series_id, round(avg(se), 6) AS stat FROM e GROUP BY series_id"""
ORACLES["corr_dim_slope"] = f"""WITH {_FOUR}, z AS (SELECT series_id, t, (x - avg(x) OVER q) / (stddev_pop(x) OVER q + 1e-12) AS z FROM s WINDOW q AS (PARTITION BY series_id)),
  w AS (SELECT series_id, t, z, {', '.join(f'lead(z, {i}) OVER q AS z{i}' for i in range(1, 7))} FROM z WHERE t < 1200 WINDOW q AS (PARTITION BY series_id ORDER BY t)),
  p AS (SELECT a.series_id, (a.z - b.z)^2 + (a.z1 - b.z1)^2 AS d2, {', '.join(f'(a.z{i} - b.z{i})^2 AS e{i}' for i in range(2, 7))} FROM w a JOIN w b ON a.series_id = b.series_id AND a.t < b.t),
  d AS (SELECT series_id, unnest([2, 3, 4, 5, 6, 7]) AS m, unnest([d2, {', '.join('d2 + ' + ' + '.join(f'e{j}' for j in range(2, i + 1)) for i in range(2, 7))}]) AS d FROM p),
  c AS (SELECT series_id, m, r, count(*) FILTER (sqrt(d) < pow(10, r)) / count(*) AS c FROM d, (SELECT -1.5 + i * 1.7 / 13 AS r FROM range(0, 14) q(i)) WHERE d > 0 GROUP BY series_id, m, r),
  l AS (SELECT series_id, m, regr_slope(log10(c), r) AS slope FROM c WHERE c > 0 GROUP BY series_id, m HAVING count(*) >= 3)
  SELECT series_id, round(max_by(slope, m) - min_by(slope, m), 6) AS stat FROM l GROUP BY series_id"""


@register(
    f"""WITH {DRAWS}, s AS (SELECT t, {SUM} AS x, CAST(blue AS DOUBLE) AS y FROM draws WHERE t < 2000),
  b AS (SELECT t, least(7, floor((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 8)) AS xb, least(7, floor((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 8)) AS yb FROM s),
  c AS (SELECT xb, yb, zb, count(*) AS c FROM (SELECT *, lead(yb) OVER (ORDER BY t) AS zb FROM b) WHERE zb IS NOT NULL GROUP BY ALL)
  SELECT round(sum(m), 6) AS stat FROM (SELECT c / sum(c) OVER () * log2(c * sum(c) OVER (PARTITION BY yb) / (sum(c) OVER (PARTITION BY xb, yb) * sum(c) OVER (PARTITION BY yb, zb))) AS m FROM c)"""
)
def transfer_entropy(spark, sf_dir):
    rows = derived(spark, sf_dir).select("t", signals.column("red_sum").alias("x"), signals.column("blue").alias("y"))
    return _one(statistics.transfer_entropy(rows))


@register(f"WITH {USERS}, c AS (SELECT user_id, t, x - avg(x) OVER (PARTITION BY user_id) AS x FROM s), l AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY t) AS p FROM c) SELECT user_id, round(CASE WHEN sum(x * x) > 1e-12 THEN coalesce(sum(x * p), 0) / sum(x * x) ELSE 0 END, 6) + 0.0 AS stat FROM l GROUP BY user_id")
def user_autocorr(spark, sf_dir):
    return statistics.autocorr(user_series(spark, sf_dir), ["user_id"]).select("user_id", r6(F.col("stat")).alias("stat"))


@register(f"WITH {USERS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT user_id, round(avg(CASE WHEN t >= n // 2 THEN x END) - avg(CASE WHEN t < n // 2 THEN x END), 6) + 0.0 AS stat FROM n GROUP BY user_id")
def user_drift(spark, sf_dir):
    return statistics.drift(user_series(spark, sf_dir), ["user_id"]).select("user_id", r6(F.col("stat")).alias("stat"))


# ---- surrogates


@register(f"WITH {X}, k AS (SELECT unnest(range(0, 3)) AS sid) SELECT CAST(sid AS INTEGER) AS sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY md5('11:' || sid || ':' || t)) - 1 AS BIGINT) AS t, x FROM s, k")
def null_shuffle(spark, sf_dir):
    return resampling.shuffled(sums(spark, sf_dir), 3, 11).select("sid", "t", "x")


@register(
    f"""WITH {DRAWS}, f AS (SELECT ball, count(*) AS w FROM (SELECT unnest(reds) AS ball FROM draws) GROUP BY ball),
  k AS (SELECT t, ball, row_number() OVER (PARTITION BY t ORDER BY -ln((CAST('0x' || substr(md5('13:0:' || t || ':' || ball), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / w) AS n FROM draws, f),
  r AS (SELECT t, list_sort(list(ball)) AS reds FROM k WHERE n <= 6 GROUP BY t),
  b AS (SELECT blue, sum(count(*)) OVER (ORDER BY blue) AS cum, count(*) AS w FROM draws GROUP BY blue),
  p AS (SELECT t, (CAST('0x' || substr(md5('13:0:' || t || ':blue'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 * (SELECT count(*) FROM draws) AS p FROM draws)
  SELECT r.t, reds[1] AS r1, reds[6] AS r6, CAST(list_sum(reds) AS BIGINT) AS red_sum, b.blue FROM r JOIN p USING (t) JOIN b ON p.p <= b.cum AND p.p > b.cum - b.w"""
)
def null_subset_marginal(spark, sf_dir):
    made = resampling.subset_marginal(derived(spark, sf_dir), 1, 13)
    return made.select("t", F.element_at("reds", 1).alias("r1"), F.element_at("reds", 6).alias("r6"), signals.total(F.col("reds")).cast("long").alias("red_sum"), "blue")


@register(
    f"""WITH {DRAWS}, k AS (SELECT t, ball, row_number() OVER (PARTITION BY t ORDER BY md5('17:' || t || ':' || ball)) AS n FROM draws, range(1, 34) r(ball))
  SELECT t, CAST(sum(ball) AS BIGINT) AS red_sum, CAST(min(ball) AS INTEGER) AS r1, CAST(max(ball) AS INTEGER) AS r6, CAST(floor((CAST('0x' || substr(md5('17:' || t || ':blue'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 * 16) + 1 AS INTEGER) AS blue FROM k WHERE n <= 6 GROUP BY t"""
)
def null_fair_draws(spark, sf_dir):
    made = resampling.random_draws(spark, derived(spark, sf_dir).count(), 17)
    return made.select("t", signals.total(F.col("reds")).cast("long").alias("red_sum"), F.element_at("reds", 1).alias("r1"), F.element_at("reds", 6).alias("r6"), "blue")


def _kept(x, y) -> float:
    """Correlation of two series' amplitude spectra, without the mean."""
    a, b = (np.abs(np.fft.rfft(v))[1:] for v in (x, y))
    return float(np.corrcoef(a, b)[0, 1])


def _phases(kind: str):
    def run(spark, sf_dir):
        import pandas as pd

        rows = statistics.packed(signals.long(derived(spark, sf_dir), ["red_sum", "blue"]), ["series_id"], longest=statistics.PASSES)
        made = resampling.surrogate_series(rows, kind, 4, 19)
        if kind == "twin":
            return made.select("series_id", "sid", F.size("x").alias("n"), r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))

        def held(key, ours, theirs):
            x = np.asarray(theirs["x"].iloc[0], float)
            out = [(s, i, len(y), hashlib.md5(",".join(str(int(v)) for v in sorted(y)).encode()).hexdigest(), _kept(x, np.asarray(y, float)) > 0.9, bool(np.array_equal(x, y))) for s, i, y in zip(ours["series_id"], ours["sid"], ours["x"])]
            return pd.DataFrame(out, columns=["series_id", "sid", "n", "digest", "spectrum_kept", "unchanged"]).astype({"sid": "int32", "n": "int32"})

        # A few surrogates of a series stand beside it.
        return made.groupBy("series_id").cogroup(rows.groupBy("series_id")).applyInPandas(held, "series_id string, sid int, n int, digest string, spectrum_kept boolean, unchanged boolean")

    run.__name__ = f"null_{kind}"
    # Values are permuted (but not by the walk), so sorted they are the series' own; their order is new, and keeps the amplitude
    # spectrum, which a shuffle of these series does not.
    register(None if kind == "twin" else f"WITH {DRAWS}, s AS (SELECT 'red_sum' AS series_id, {SUM} AS x FROM draws UNION ALL SELECT 'blue', blue FROM draws), k AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS sid) SELECT series_id, sid, CAST(count(*) AS INTEGER) AS n, md5(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY x)) AS digest, true AS spectrum_kept, false AS unchanged FROM s, k GROUP BY ALL")(run)


for _kind in ("aaft", "iaaft", "twin"):
    _phases(_kind)


_UNIT = "(CAST('0x' || substr(md5('{seed}:' || sid || ':' || f), 1, 13) AS BIGINT) + 0.5) / 4503599627370496"
# x by rank of y, from (sid, t, y); amplitudes as a frequency and its mirror image give them together.
_REMAP = "(SELECT sid, t, x FROM (SELECT sid, t, row_number() OVER (PARTITION BY sid ORDER BY y, t) AS r FROM {y}) JOIN (SELECT x, row_number() OVER (ORDER BY x, t) AS r FROM s) USING (r))"
_AMPLITUDES = f"""{X}, nn AS (SELECT count(*) AS n FROM s), fr AS (SELECT unnest(range(0, n // 2 + 1)) AS f, n FROM nn),
  am AS (SELECT f, n, sqrt(sum(x * cos(2 * pi() * (f * t % n) / n))^2 + sum(x * sin(2 * pi() * (f * t % n) / n))^2) * CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END AS a FROM s, fr GROUP BY f, n)"""


@register(
    f"""WITH {_AMPLITUDES}, tu AS (SELECT sid, f, n, a, CASE WHEN f = 0 THEN 0 ELSE 2 * pi() * {_UNIT.format(seed=19)} END AS g FROM am, range(0, 2) r(sid)),
  y AS (SELECT sid, t, sum(a * cos(2 * pi() * (f * t % n) / n + g)) AS y FROM tu, s GROUP BY sid, t)
  SELECT CAST(sid AS INTEGER) AS sid, t, x FROM {_REMAP.format(y='y')}"""
)
def phase_surrogates(spark, sf_dir):
    """Random-phase surrogates of a series of any length, value by value."""
    return spectrum.randomised(keyed(sums(spark, sf_dir)), 2, 19, ["series_id"]).select("sid", "t", "x")


def _iterated(rounds: int) -> str:
    parts = [f"WITH {_AMPLITUDES}, x0 AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY md5('19:' || sid || ':' || t)) - 1 AS t, x FROM s, range(0, 1) r(sid))"]
    for i in range(rounds):
        parts.append(f"p{i} AS (SELECT sid, f, n, a, atan2(-sum(x * sin(2 * pi() * (f * t % n) / n)), sum(x * cos(2 * pi() * (f * t % n) / n))) AS g FROM x{i}, am GROUP BY sid, f, n, a)")
        parts.append(f"y{i} AS (SELECT sid, t, sum(a * cos(2 * pi() * (f * t % n) / n + g)) AS y FROM p{i}, s GROUP BY sid, t)")
        parts.append(f"x{i + 1} AS {_REMAP.format(y=f'y{i}')}")
    return ", ".join(parts) + f" SELECT CAST(sid AS INTEGER) AS sid, t, x FROM x{rounds}"


@register(_iterated(5))
def iterated_surrogates(spark, sf_dir):
    """The iterated kind, in five rounds of transforms and ranks."""
    return spectrum.randomised(keyed(sums(spark, sf_dir)), 1, 19, ["series_id"], rounds=5).select("sid", "t", "x")


@register(
    f"""WITH {DRAWS}, v AS (SELECT t, {SUM} AS a, CAST(blue AS DOUBLE) AS b FROM draws),
  l AS (SELECT p, y, lag(y) OVER (PARTITION BY p ORDER BY t) AS y1, lag(x) OVER (PARTITION BY p ORDER BY t) AS x1 FROM (SELECT 'red_sum>blue' AS p, t, a AS x, b AS y FROM v UNION ALL SELECT 'blue>red_sum', t, b, a FROM v)),
  c AS (SELECT p, count(*) AS n, count(*) * var_pop(y) AS s, corr(y, y1) AS r1, corr(y, x1) AS r2, corr(y1, x1) AS r12 FROM l WHERE y1 IS NOT NULL GROUP BY p),
  f AS (SELECT p, n, s * (1 - r1^2) AS rest, s * (1 - (r1^2 + r2^2 - 2 * r1 * r2 * r12) / (1 - r12^2)) AS whole FROM c)
  SELECT p AS series_id, round((rest - whole) / (whole / (n - 3)), 4) AS stat FROM f"""
)
def granger(spark, sf_dir):
    """One lag, which SQL can solve; tests compare more of them with least squares."""
    d = derived(spark, sf_dir).select("t", signals.column("red_sum").alias("a"), signals.column("blue").alias("b"))
    pair = lambda name, x, y: d.select(F.lit(name).alias("series_id"), "t", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    out = statistics.granger(pair("red_sum>blue", "a", "b").unionByName(pair("blue>red_sum", "b", "a")), ["series_id"], max_lag=1)
    return out.select("series_id", F.round("stat", 4).alias("stat"))


@register(
    f"""WITH {DRAWS}, v AS (SELECT t, CAST(blue AS DOUBLE) AS x, {SUM} AS y FROM draws), w AS (SELECT t AS i, x, y AS y0, lead(y) OVER (ORDER BY t) AS y1, lead(y, 2) OVER (ORDER BY t) AS y2 FROM v QUALIFY y2 IS NOT NULL),
  z AS (SELECT DISTINCT CAST(floor(exp(ln(8) + k * (ln(n) - ln(8)) / 7) + CASE WHEN k IN (0, 7) THEN 1e-6 ELSE 0 END) AS BIGINT) AS size FROM range(0, 8) r(k), (SELECT count(*) AS n FROM w)),
  d AS (SELECT size, a.i, b.i AS j, b.x AS u, sqrt((a.y0 - b.y0)^2 + (a.y1 - b.y1)^2 + (a.y2 - b.y2)^2) AS d FROM z, w a, w b WHERE b.i < size AND a.i <> b.i),
  k AS (SELECT size, i, unnest(min(struct_pack(d := d, j := j, u := u), 4), recursive := true) FROM d GROUP BY size, i), e AS (SELECT *, min(d) OVER (PARTITION BY size, i) AS d0 FROM k),
  g AS (SELECT size, i, sum(exp(-d / greatest(d0, 1e-12)) * u) / sum(exp(-d / greatest(d0, 1e-12))) AS guess FROM e GROUP BY size, i)
  SELECT round(greatest(0, max(c)), 6) AS stat FROM (SELECT size, corr(guess, x) AS c FROM g JOIN w USING (i) GROUP BY size)"""
)
def ccm(spark, sf_dir):
    """How well the red sums' delay space tells the blue ball, over all draws, by cells of the delay space."""
    return _one(neighbours.ccm(derived(spark, sf_dir).select("t", signals.column("blue").alias("x"), signals.column("red_sum").alias("y")), cell=1 << 12))
