"""Queries over evaluations, gates, forecasts, records and streams, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import functions as F

from seqsieve.functions import signals
from seqsieve.operators import evaluation, forecast, gates, governance, ledger, proposals, resampling, scans, search, series, statistics
from seqsieve.plans.signal_queries import DRAWS, GAPS, SUM, X, keyed, r6, sums
from seqsieve.sources import draws as draw_source
from seqsieve.sources import logs
from seqsieve.sources.draws import derived, table
from seqsieve.sources.evaluations import Evaluations
from seqsieve.sources.shared import shared_dir
from seqsieve.streaming import jobs

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# ---- evaluation


@register(
    f"""WITH {X}, k AS (SELECT unnest(range(0, 200)) AS sid), m AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY md5('0:' || sid || ':' || t)) - 1 AS t, x FROM s, k UNION ALL SELECT -1, t, x FROM s),
  l AS (SELECT sid, x, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3, lag(x, 4) OVER w AS x4, lag(x, 5) OVER w AS x5 FROM m WINDOW w AS (PARTITION BY sid ORDER BY t)),
  a AS (SELECT sid, greatest(abs(corr(x, x1)), abs(corr(x, x2)), abs(corr(x, x3)), abs(corr(x, x4)), abs(corr(x, x5))) AS stat FROM l GROUP BY sid),
  r AS (SELECT stat AS r FROM a WHERE sid = -1)
  SELECT 'red_sum' AS sig, 'acf_max' AS test, round(max(r), 6) AS stat, round(avg(stat), 6) AS sur_mean, round(stddev_pop(stat), 6) AS sur_std, round((max(r) - avg(stat)) / stddev_pop(stat), 4) AS z,
         round((1 + count(*) FILTER (stat >= r)) / (1.0 + count(*)), 6) AS p_raw, count(*) AS k_sur FROM a, r WHERE sid >= 0"""
)
def shuffle_p(spark, sf_dir):
    rows = keyed(sums(spark, sf_dir)).select("series_id", "t", "x")
    if rows.count() <= statistics.PASSES:
        out = evaluation.evaluate(rows, ["acf_max"], k=200, knobs={"acf_max": {"maxlag": 5}})
    else:
        out = evaluation.evaluate_long(rows, "acf_max", k=200, maxlag=5)
    return out.select("sig", "test", r6(F.col("stat")).alias("stat"), r6(F.col("sur_mean")).alias("sur_mean"), r6(F.col("sur_std")).alias("sur_std"), F.round("z", 4).alias("z"), r6(F.col("p_raw")).alias("p_raw"), "k_sur")


def _two(spark, sf_dir):
    return derived(spark, sf_dir).select(F.lit("red_sum>blue").alias("series_id"), "t", signals.column("red_sum").alias("x"), signals.column("blue").alias("y"))


@register(
    f"""WITH {DRAWS}, s AS (SELECT t, {SUM} AS x, CAST(blue AS DOUBLE) AS y FROM draws),
  m AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY md5('3:' || sid || ':' || t)) - 1 AS t, x, y FROM s, range(0, 40) r(sid) UNION ALL SELECT -1, t, x, y FROM s), w AS (SELECT * FROM m WHERE t < 2000),
  b AS (SELECT sid, t, least(7, floor((x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) * 8)) AS xb, least(7, floor((y - min(y) OVER p) / (max(y) OVER p - min(y) OVER p) * 8)) AS yb FROM w WINDOW p AS (PARTITION BY sid)),
  c AS (SELECT sid, xb, yb, zb, count(*) AS c FROM (SELECT *, lead(yb) OVER (PARTITION BY sid ORDER BY t) AS zb FROM b) WHERE zb IS NOT NULL GROUP BY ALL),
  g AS (SELECT sid, greatest(0, sum(m)) AS stat FROM (SELECT sid, c / sum(c) OVER (PARTITION BY sid) * log2(c * sum(c) OVER (PARTITION BY sid, yb) / (sum(c) OVER (PARTITION BY sid, xb, yb) * sum(c) OVER (PARTITION BY sid, yb, zb))) AS m FROM c) GROUP BY sid)
  SELECT 'red_sum>blue' AS series_id, round(max(r), 6) AS stat, round(avg(stat), 6) AS sur_mean, round((1 + count(*) FILTER (stat >= r)) / (1.0 + count(*)), 6) AS p_raw, count(*) AS k_sur FROM g, (SELECT stat AS r FROM g WHERE sid = -1) WHERE sid >= 0"""
)
def joint_shuffle(spark, sf_dir):
    out = evaluation.evaluate_pair(_two(spark, sf_dir), "transfer_entropy", k=40, seed=3)
    return out.select("series_id", *[r6(F.col(c)).alias(c) for c in ("stat", "sur_mean", "p_raw")], "k_sur")


# Balls' drift and momentum as SQL: sums over appearances and over neighbouring appearances.
_BALLS = """e AS (SELECT sid, t, n, 'red' AS colour, unnest(reds) AS ball FROM d UNION ALL SELECT sid, t, n, 'blue', blue FROM d),
  h AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY sid, colour, ball ORDER BY t) = t - 1 THEN 1 ELSE 0 END AS bth FROM e),
  b AS (SELECT sid, colour, CAST(ball AS INTEGER) AS ball, max(n) AS n, count(*) AS c, count(*) FILTER (t >= n // 2) AS late, count(*) FILTER (t = 0) AS first, count(*) FILTER (t = n - 1) AS last, sum(bth) AS bth FROM h GROUP BY ALL),
  v AS (SELECT sid, colour, ball, late / (n - n // 2) - (c - late) / (n // 2) AS drift,
        CASE WHEN c - n * (c / n)^2 > 1e-12 THEN (bth - (c / n) * (2 * c - first - last) + (n - 1) * (c / n)^2) / (c - n * (c / n)^2) ELSE 0 END AS momentum FROM b)"""


@register(f"WITH {DRAWS}, d AS (SELECT 0 AS sid, *, count(*) OVER () AS n FROM draws), {_BALLS} SELECT colour, ball, round(drift, 6) + 0.0 AS drift, round(momentum, 6) + 0.0 AS momentum FROM v")
def ball_stats(spark, sf_dir):
    return scans.ball_stats(derived(spark, sf_dir)).select("colour", "ball", r6(F.col("drift")).alias("drift"), r6(F.col("momentum")).alias("momentum"))


_K = 20
_SCAN = f"""{DRAWS}, d AS (SELECT -1 AS sid, t, reds, blue, count(*) OVER () AS n FROM draws UNION ALL
    SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY md5('5:' || sid || ':' || t)) - 1, reds, blue, (SELECT count(*) FROM draws) FROM draws, range(0, {_K}) r(sid)), {_BALLS},
  p AS (SELECT r.colour, r.ball, r.drift, r.momentum, (1 + count(*) FILTER (abs(s.drift) >= abs(r.drift) - 1e-9)) / {1.0 + _K} AS p_drift, (1 + count(*) FILTER (abs(s.momentum) >= abs(r.momentum) - 1e-9)) / {1.0 + _K} AS p_momentum
        FROM v r JOIN v s ON r.sid = -1 AND s.sid >= 0 AND r.colour = s.colour AND r.ball = s.ball GROUP BY ALL)"""


def _bh_sql(p: str, source: str, keep: str) -> str:
    return f"SELECT {keep}, least(1, min(least(1, {p} * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {p}, colour, ball) AS k FROM {source})"


def _drift_scan(spark, sf_dir):
    return scans.ball_drift_scan(derived(spark, sf_dir), k=_K, seed=5)


@register(
    f"""WITH {_SCAN}, qd AS ({_bh_sql('p_drift', 'p', 'colour, ball')}), qm AS ({_bh_sql('p_momentum', 'p', 'colour, ball')})
  SELECT p.colour, p.ball, round(drift, 6) + 0.0 AS drift, round(momentum, 6) + 0.0 AS momentum, round(p_drift, 6) AS p_drift, round(p_momentum, 6) AS p_momentum, round(qd.q, 6) AS q_drift, round(qm.q, 6) AS q_momentum
  FROM p JOIN qd USING (colour, ball) JOIN qm USING (colour, ball)"""
)
def drift_momentum(spark, sf_dir):
    return _drift_scan(spark, sf_dir).select("colour", "ball", *[r6(F.col(c)).alias(c) for c in ("drift", "momentum", "p_drift", "p_momentum", "q_drift", "q_momentum")])


@register(
    f"""WITH {DRAWS}, d AS (SELECT t, (SELECT count(*) FROM draws) AS n, reds, blue FROM draws), e AS (SELECT t, n, 'red' AS colour, unnest(reds) AS ball FROM d UNION ALL SELECT t, n, 'blue', blue FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY colour, ball ORDER BY t) - 1 AS rk, count(*) OVER (PARTITION BY colour, ball) AS c FROM e),
  s AS (SELECT colour, CAST(ball AS INTEGER) AS ball, CAST(max(n) AS DOUBLE) AS n, CAST(max(c) AS DOUBLE) AS c, CAST(sum((t - rk) - (n - 1 - t - (c - 1 - rk))) AS DOUBLE) AS s FROM r GROUP BY colour, ball),
  v AS (SELECT *, (n * (n - 1) * (2 * n + 5) - c * (c - 1) * (2 * c + 5) - (n - c) * (n - c - 1) * (2 * (n - c) + 5)) / 18 AS var FROM s)
  SELECT colour, ball, round((s - sign(s)) / sqrt(var), 6) + 0.0 AS mk_z FROM v"""
)
def mann_kendall(spark, sf_dir):
    return scans.mann_kendall(derived(spark, sf_dir)).select("colour", "ball", r6(F.col("mk_z")).alias("mk_z"))


@register(
    f"""WITH {DRAWS}, w AS (SELECT unnest(range(0, greatest(0, (count(*) - 200) // 50) + 1)) AS sid FROM draws), d AS (SELECT sid, t - sid * 50 AS t, reds, blue, count(*) OVER (PARTITION BY sid) AS n FROM draws JOIN w ON t >= sid * 50 AND t < sid * 50 + 200), {_BALLS}
  SELECT CAST(sid AS INTEGER) AS w, round(max(abs(drift)), 6) AS max_drift, round(max(abs(momentum)), 6) AS max_momentum FROM v GROUP BY sid"""
)
def rolling_scan(spark, sf_dir):
    d = derived(spark, sf_dir)
    return scans.rolling_scan(d, d.count()).select("w", r6(F.col("max_drift")).alias("max_drift"), r6(F.col("max_momentum")).alias("max_momentum"))


def _user_p(spark, sf_dir):
    """A rank p-value of each user and event type: where the type's mean value stands among all of the user's.

    A value that equals its user's mean is not above it. Sums of doubles depend on the order of rows, and so would that; the
    mean is of decimals, or of doubles for a user with a value that is no decimal of ten places."""
    e = table(spark, sf_dir, "events")
    exact = F.col("value").try_cast("decimal(28,10)")
    whole = F.count(exact) == F.count("value")
    mean = e.groupBy("user_id").agg(F.when(whole, F.avg(exact).cast("double")).otherwise(F.avg("value")).alias("m"))
    return e.join(mean, "user_id").groupBy("user_id", "event_type").agg(((1 + F.sum((F.col("value") > F.col("m")).cast("int"))) / (1 + F.count(F.lit(1)))).alias("p_raw"))


_USER_P = "p AS (SELECT user_id, event_type, (1 + count(*) FILTER (value > m)) / (1.0 + count(*)) AS p_raw FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY ALL)"


@register(f"WITH {_USER_P}, k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_raw, user_id, event_type) AS k FROM p) SELECT user_id, event_type, round(p_raw, 6) AS p_raw, round(min(least(1, p_raw * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM k")
def bh_fdr(spark, sf_dir):
    return evaluation.bh_fdr(_user_p(spark, sf_dir)).select("user_id", "event_type", r6(F.col("p_raw")).alias("p_raw"), r6(F.col("q")).alias("q"))


@register(f"WITH {_USER_P}, h AS (SELECT user_id, -sum(ln(p_raw)) AS h, count(*) AS n FROM p GROUP BY user_id) SELECT user_id, CAST(n AS INTEGER) AS n, round(exp(-h) * list_sum(list_transform(range(0, n), lambda i: pow(h, i) / factorial(CAST(i AS INTEGER)))), 6) AS p_comb FROM h")
def fisher(spark, sf_dir):
    return evaluation.fisher(_user_p(spark, sf_dir), ["user_id"]).select("user_id", "n", r6(F.col("p_comb")).alias("p_comb"))


@register(
    """WITH n AS (SELECT event_type, count(*) AS n, CAST(floor(count(*) * 0.7) AS BIGINT) AS base FROM events GROUP BY event_type), f AS (SELECT *, (n - base) // 3 AS size, f FROM n, range(0, 3) r(f)),
  o AS (SELECT event_type, CAST(f AS INTEGER) AS fold, base + f * size AS d_end, base + f * size AS c_start, CASE WHEN f = 2 THEN n ELSE base + (f + 1) * size END AS c_end FROM f WHERE n - base >= 90
        UNION ALL SELECT event_type, 0, base, base, n FROM n WHERE n - base < 90)
  SELECT * FROM o WHERE c_end - c_start >= 30"""
)
def walk_forward_folds(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", F.explode(evaluation.folds(F.col("n"))).alias("f")).select("event_type", *[F.col(f"f.{c}").cast(k).alias(c) for c, k in (("fold", "int"), ("d_end", "long"), ("c_start", "long"), ("c_end", "long"))])


def _fold_p(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("fold", F.pmod("event_id", F.lit(3)))
    share = lambda c: (1 + F.sum(c.cast("int"))) / (2 + 4 * F.count(F.lit(1)))
    return e.groupBy("user_id", "fold").agg(share(F.col("event_type") == "click").alias("disc_p"), share(F.col("event_type") == "view").alias("conf_p"))


@register(
    """WITH p AS (SELECT user_id, event_id % 3 AS fold, (1 + count(*) FILTER (event_type = 'click')) / (2.0 + 4 * count(*)) AS disc_p, (1 + count(*) FILTER (event_type = 'view')) / (2.0 + 4 * count(*)) AS conf_p FROM events GROUP BY ALL),
  h AS (SELECT user_id, -sum(ln(disc_p)) AS d, -sum(ln(conf_p)) AS c, count(*) AS n, count(*) FILTER (conf_p < 0.05) AS n_confirm FROM p GROUP BY user_id),
  f AS (SELECT user_id, n, n_confirm, exp(-d) * list_sum(list_transform(range(0, n), lambda i: pow(d, i) / factorial(CAST(i AS INTEGER)))) AS dp, exp(-c) * list_sum(list_transform(range(0, n), lambda i: pow(c, i) / factorial(CAST(i AS INTEGER)))) AS cp FROM h)
  SELECT user_id, round(dp, 6) AS disc_combined_p, round(cp, 6) AS conf_combined_p, n_confirm, CASE WHEN dp < .05 AND cp < .05 AND n_confirm >= (n + 1) // 2 THEN 'SIGNAL' WHEN dp < .05 THEN 'UNCONFIRMED' ELSE 'NULL' END AS verdict FROM f"""
)
def confirm_verdict(spark, sf_dir):
    return evaluation.verdict(_fold_p(spark, sf_dir), ["user_id"]).select("user_id", r6(F.col("disc_combined_p")).alias("disc_combined_p"), r6(F.col("conf_combined_p")).alias("conf_combined_p"), "n_confirm", "verdict")


@register(
    f"""WITH {_USER_P}, k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_raw, user_id, event_type) AS k FROM p), q AS (SELECT *, min(least(1, p_raw * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q0 FROM k),
  d AS (SELECT *, event_type = 'error' AS artifact, CASE WHEN event_type = 'error' THEN 1 ELSE q0 END AS q FROM q)
  SELECT user_id, event_type AS sig, artifact, round(q, 6) AS q, CASE WHEN q < .05 THEN 'SIGNAL' WHEN q < .2 THEN 'BORDERLINE' ELSE 'NULL' END AS verdict FROM d"""
)
def verdict_bands(spark, sf_dir):
    gone = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_type").alias("sig")).distinct()
    return evaluation.bands(_user_p(spark, sf_dir).withColumnRenamed("event_type", "sig"), gone).select("user_id", "sig", "artifact", r6(F.col("q")).alias("q"), "verdict")


@register(f"WITH {_USER_P} SELECT CAST((p_raw >= .01)::INT + (p_raw >= .05)::INT + (p_raw >= .1)::INT + (p_raw >= .2)::INT + (p_raw >= .5)::INT AS INTEGER) AS bin, count(*) AS n FROM p WHERE p_raw BETWEEN 0 AND 1 GROUP BY 1")
def p_histogram(spark, sf_dir):
    return gates.p_histogram(_user_p(spark, sf_dir))


# ---- gates

_RATES = """f AS (SELECT t, sign(lead(x) OVER w - x) AS actual, coalesce(sign(x - lag(x) OVER w), 0) AS cont, (SELECT count(*) FROM s) AS n FROM s WINDOW w AS (ORDER BY t)),
  v AS (SELECT t, actual, cont, n FROM f WHERE actual <> 0 AND cont <> 0),
  c AS (SELECT count(*) FILTER (t < floor({a} * n)) AS ln, count(*) FILTER (t < floor({a} * n) AND cont = actual) AS lk, count(*) FILTER (t >= floor({b} * n)) AS tn, count(*) FILTER (t >= floor({b} * n) AND cont = actual) AS tk FROM v),
  r AS (SELECT CASE WHEN ln >= 30 THEN lk / ln ELSE .5 END AS up, CASE WHEN ln >= 30 THEN (ln - lk) / ln ELSE .5 END AS down, tn, tk FROM c)
  SELECT CASE WHEN up >= down THEN 'cont' ELSE 'rev' END AS rule, round(greatest(up, down), 6) AS learn_rate, CASE WHEN tn >= 30 THEN round(CASE WHEN up >= down THEN tk ELSE tn - tk END / tn, 6) END AS hit_rate, CAST(tn AS BIGINT) AS tested FROM r"""


def _rates(df):
    return df.select("rule", r6(F.col("learn_rate")).alias("learn_rate"), r6(F.col("hit_rate")).alias("hit_rate"), F.col("tested").cast("long").alias("tested"))


@register(f"WITH {X}, {_RATES.format(a=0.8, b=0.8)}")
def oos_hitrate(spark, sf_dir):
    rows = sums(spark, sf_dir)
    return _rates(gates.out_of_sample(rows, rows.count()))


@register(f"WITH {X}, {_RATES.format(a=0.85, b=0.91)}")
def oot_hitrate(spark, sf_dir):
    rows = sums(spark, sf_dir)
    return _rates(gates.out_of_time(rows, rows.count()))


#: Directions of a series and of its shuffles (sid -1 is the series itself), and what the two rules say.
_STEPS = """m AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY md5('{seed}:' || sid || ':' || t)) - 1 AS t, x FROM s, range(0, {k}) r(sid) UNION ALL SELECT -1, t, x FROM s),
  f AS (SELECT sid, t, sign(lead(x) OVER w - x) AS actual, coalesce(sign(x - lag(x) OVER w), 0) AS cont, (SELECT count(*) FROM s) AS n FROM m WINDOW w AS (PARTITION BY sid ORDER BY t))"""


@register(
    f"""WITH {X}, {_STEPS.format(seed=2, k=20)}, v AS (SELECT * FROM f WHERE actual <> 0 AND cont <> 0),
  c AS (SELECT sid, count(*) FILTER (t < floor(.8 * n)) AS ln, count(*) FILTER (t < floor(.8 * n) AND cont = actual) AS lk, count(*) FILTER (t >= floor(.8 * n)) AS tn, count(*) FILTER (t >= floor(.8 * n) AND cont = actual) AS tk FROM v GROUP BY sid),
  r AS (SELECT sid, CASE WHEN ln >= 30 THEN lk / ln ELSE .5 END AS up, CASE WHEN ln >= 30 THEN (ln - lk) / ln ELSE .5 END AS down, tn, tk FROM c),
  h AS (SELECT sid, CASE WHEN up >= down THEN 'cont' ELSE 'rev' END AS rule, CASE WHEN tn >= 30 THEN CASE WHEN up >= down THEN tk ELSE tn - tk END / tn END AS h FROM r), o AS (SELECT * FROM h WHERE sid = -1)
  SELECT max(o.rule) AS rule, round(max(o.h), 6) AS hit_rate, count(*) FILTER (h.h >= o.h) AS as_good, count(*) AS k_sur, round(least(1, (count(*) FILTER (h.h >= o.h) + .5) / count(*)), 6) AS p FROM h, o WHERE h.sid >= 0 AND h.h IS NOT NULL"""
)
def oos_hitrate_p(spark, sf_dir):
    rows = sums(spark, sf_dir)
    return gates.hit_rate_p(rows, rows.count(), k=20, seed=2).select("rule", r6(F.col("hit_rate")).alias("hit_rate"), F.col("as_good").cast("long").alias("as_good"), "k_sur", r6(F.col("p")).alias("p"))


@register(
    f"""WITH {X}, {_STEPS.format(seed=9, k=20)}, v AS (SELECT * FROM f WHERE sid = -1 AND actual <> 0 AND cont <> 0),
  c AS (SELECT count(*) FILTER (t < floor(.85 * n)) AS ln, count(*) FILTER (t < floor(.85 * n) AND cont = actual) AS lk, count(*) FILTER (t >= floor(.91 * n)) AS tn, count(*) FILTER (t >= floor(.91 * n) AND cont = actual) AS tk FROM v),
  o AS (SELECT CASE WHEN ln < 30 OR lk >= ln - lk THEN 'cont' ELSE 'rev' END AS rule, tn, tk FROM c), a AS (SELECT t, actual FROM f WHERE sid = -1 AND actual IS NOT NULL),
  h AS (SELECT f.sid, avg(CASE WHEN CASE rule WHEN 'cont' THEN cont ELSE -cont END = a.actual THEN 1 ELSE 0 END) AS h FROM f JOIN a USING (t), o WHERE f.sid >= 0 AND f.t >= floor(.91 * n) AND cont <> 0 AND a.actual <> 0 GROUP BY f.sid HAVING count(*) >= 30),
  e AS (SELECT rule, CASE WHEN tn >= 30 THEN CASE rule WHEN 'cont' THEN tk ELSE tn - tk END / tn END AS hr FROM o)
  SELECT max(rule) AS rule, round(max(hr), 6) AS hit_rate, round(avg(h), 6) AS sur_mean, count(*) FILTER (h >= hr) AS as_good, count(h) AS k_sur, CASE WHEN count(h) > 0 AND max(hr) IS NOT NULL THEN round(least(1, (count(*) FILTER (h >= hr) + .5) / count(h)), 6) END AS p FROM e LEFT JOIN h ON true"""
)
def oot_hitrate_p(spark, sf_dir):
    rows = sums(spark, sf_dir)
    out = gates.out_of_time_p(rows, rows.count(), k=20, seed=9)
    return out.select("rule", r6(F.col("hit_rate")).alias("hit_rate"), r6(F.col("sur_mean")).alias("sur_mean"), F.col("as_good").cast("long").alias("as_good"), "k_sur", r6(F.col("p")).alias("p"))


def _lag_corr(most: int) -> str:
    """SQL of the largest absolute correlation over the lags of z(id, sid, t, x)."""
    lags = ", ".join(f"lag(x, {i}) OVER w AS x{i}" for i in range(1, most + 1))
    best = ", ".join(f"abs(corr(x, x{i}))" for i in range(1, most + 1))
    return f"l AS (SELECT id, sid, x, {lags} FROM z WINDOW w AS (PARTITION BY id, sid ORDER BY t)), a AS (SELECT id, sid, greatest({best}) AS stat FROM l GROUP BY id, sid)"


@register(
    f"""WITH {DRAWS}, s AS (SELECT 'red_sum' AS id, t, {SUM} AS x FROM draws UNION ALL SELECT 'blue', t, blue FROM draws), n AS (SELECT count(*) AS n, CAST(floor(count(*) * .8) AS BIGINT) AS cut FROM draws),
  d AS (SELECT id, t - cut AS t, x FROM s, n WHERE t >= CASE WHEN n - cut >= 60 THEN cut ELSE n END),
  z AS (SELECT id, sid, row_number() OVER (PARTITION BY id, sid ORDER BY md5('6:' || sid || ':' || t)) - 1 AS t, x FROM d, range(0, 25) r(sid) UNION ALL SELECT id, -1, t, x FROM d), {_lag_corr(5)}
  SELECT a.id AS sig, round(max(r.stat), 6) AS stat, round(avg(a.stat), 6) AS sur_mean, round((1 + count(*) FILTER (a.stat >= r.stat)) / (1.0 + count(*)), 6) AS p_raw, count(*) AS k_sur FROM a JOIN a r ON r.id = a.id AND r.sid = -1 WHERE a.sid >= 0 GROUP BY a.id"""
)
def oos_reevaluate(spark, sf_dir):
    d = derived(spark, sf_dir)
    out = gates.reevaluate(signals.long(d, ["red_sum", "blue"]), d.count(), ["acf_max"], k=25, seed=6, knobs={"acf_max": {"maxlag": 5}})
    return out.select("sig", *[r6(F.col(c)).alias(c) for c in ("stat", "sur_mean", "p_raw")], "k_sur")


_CONFIRM = f"""{DRAWS}, s AS (SELECT 'red_sum' AS id, t, {SUM} AS x FROM draws UNION ALL SELECT 'red_gap_max', t, list_max({GAPS}) FROM draws),
  n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.7) AS BIGINT) AS base FROM draws), g AS (SELECT *, (n - base) // 3 AS size, f FROM n, range(0, 3) r(f)),
  o AS (SELECT f, base + f * size AS c_start, CASE WHEN f = 2 THEN n ELSE base + (f + 1) * size END AS c_end FROM g WHERE n - base >= 90 UNION ALL SELECT 0, base, n FROM n WHERE n - base < 90),
  q AS (SELECT f, 'disc' AS part, 0 AS lo, c_start AS hi FROM o WHERE c_end - c_start >= 30 UNION ALL SELECT f, 'conf', c_start, c_end FROM o WHERE c_end - c_start >= 30),
  d AS (SELECT id || '#' || f || '#' || part AS id, t - lo AS t, x FROM s JOIN q ON t >= lo AND t < hi),
  z AS (SELECT id, sid, row_number() OVER (PARTITION BY id, sid ORDER BY md5('4:' || sid || ':' || t)) - 1 AS t, x FROM d, range(0, 30) r(sid) UNION ALL SELECT id, -1, t, x FROM d), {_lag_corr(8)},
  p AS (SELECT a.id, (1 + count(*) FILTER (a.stat >= r.stat)) / (1.0 + count(*)) AS p FROM a JOIN a r ON r.id = a.id AND r.sid = -1 WHERE a.sid >= 0 GROUP BY a.id),
  h AS (SELECT split_part(id, '#', 1) AS sig, -sum(ln(p)) FILTER (split_part(id, '#', 3) = 'disc') AS d, -sum(ln(p)) FILTER (split_part(id, '#', 3) = 'conf') AS c, count(*) FILTER (split_part(id, '#', 3) = 'conf') AS n, count(*) FILTER (split_part(id, '#', 3) = 'conf' AND p < .05) AS n_confirm FROM p GROUP BY 1),
  v AS (SELECT sig, n, n_confirm, exp(-d) * list_sum(list_transform(range(0, n), lambda i: pow(d, i) / factorial(CAST(i AS INTEGER)))) AS dp, exp(-c) * list_sum(list_transform(range(0, n), lambda i: pow(c, i) / factorial(CAST(i AS INTEGER)))) AS cp FROM h),
  w AS (SELECT sig, round(dp, 6) AS disc_combined_p, round(cp, 6) AS conf_combined_p, n_confirm, CASE WHEN dp < .05 AND cp < .05 AND n_confirm >= (n + 1) // 2 THEN 'SIGNAL' WHEN dp < .05 THEN 'UNCONFIRMED' ELSE 'NULL' END AS verdict FROM v)"""


def _confirmed(spark, sf_dir):
    d = derived(spark, sf_dir)
    out = gates.confirm(signals.long(d, ["red_sum", "red_gap_max"]), "acf_max", d.count(), k=30, seed=4, knobs={"maxlag": 8})
    return out.select("sig", r6(F.col("disc_combined_p")).alias("disc_combined_p"), r6(F.col("conf_combined_p")).alias("conf_combined_p"), "n_confirm", "verdict")


@register(f"WITH {_CONFIRM} SELECT * FROM w")
def confirm_candidate(spark, sf_dir):
    return _confirmed(spark, sf_dir)


@register(f"WITH {_CONFIRM} SELECT sig, CAST(3 AS INTEGER) AS n_folds, disc_combined_p AS discovery_combined_p, conf_combined_p AS confirmation_combined_p, n_confirm AS n_folds_confirmed, verdict, true AS positive_control_passed FROM w")
def model_card(spark, sf_dir):
    return gates.model_card(_confirmed(spark, sf_dir), control=True).drop("note")


@register()
def spectral_scan(spark, sf_dir):
    """All signals under all spectral tests, the peak of the spectrum against 2500 surrogates."""
    return scans.spectral_scan(derived(spark, sf_dir), seed=1)


@register()
def causal_scan(spark, sf_dir):
    """All four pairs over all draws."""
    return scans.causal_scan(derived(spark, sf_dir), k=20, seed=1)


@register()
def label_axes(spark, sf_dir):
    return scans.label_axes(derived(spark, sf_dir), ["red_sum", "red_parity"], k=40, seed=1)


@register()
def axis_scan(spark, sf_dir):
    return scans.axis_scan(derived(spark, sf_dir), evolved=[{"sig": "comp", "test": "acf_max", "params": {"_comp": {"op": "*", "a": "red_sum", "b": "blue"}, "_test": {"maxlag": 12}}}], seed=1)


@register()
def random_control(spark, sf_dir):
    return scans.artifacts(derived(spark, sf_dir), ["red_sum", "red_parity"], k=60, seed=1)


@register()
def artifact_prone(spark, sf_dir):
    d = derived(spark, sf_dir)
    evals = evaluation.evaluate(scans.signal_series(d, ["red_sum", "red_recurrence_mean", "red_parity"]), ["acf_max", "mi_max"], k=20, seed=2)
    return scans.artifact_prone(d, evals, k=20, seed=1)


@register()
def ingest_gate(spark, sf_dir):
    comp = json.dumps({"_comp": {"op": "-", "a": "red_sum", "b": {"op": "lag", "a": "blue", "k": 3}}})
    asked = [("red_sum", "acf_max", None), ("red_sum", "acf_max", '{"_test": {"maxlag": 7}}'), ("red_recurrence_mean", "acf_max", None), ("blue", "perm_entropy", '{"_test": {"order": 4}}'), ("comp", "mi_max", comp), ("no_such", "acf_max", None), ("red_sum", "acf_max", '{"_test": {"no_such": 7}}')]
    return gates.ingest(derived(spark, sf_dir), spark.createDataFrame(asked, "sig string, test string, params string"), seed=1)


@register()
def cross_null(spark, sf_dir):
    return scans.cross_null(signals.long(derived(spark, sf_dir), ["red_sum", "blue"]), ["acf_max"], k=40, seed=1)


_RK = 100


@register(
    f"""WITH {DRAWS}, w AS (SELECT unnest(range(0, greatest(0, (count(*) - 200) // 50) + 1)) AS w FROM draws), e0 AS (SELECT w, t - w * 50 AS t, reds, blue, count(*) OVER (PARTITION BY w) AS n FROM draws JOIN w ON t >= w * 50 AND t < w * 50 + 200),
  d AS (SELECT w * 1000 AS sid, t, reds, blue, n FROM e0 UNION ALL SELECT w * 1000 + k + 1, row_number() OVER (PARTITION BY w, k ORDER BY md5('7:' || k || ':' || t)) - 1, reds, blue, n FROM e0, range(0, {_RK}) r(k)), {_BALLS},
  p AS (SELECT r.sid // 1000 AS w, r.colour, r.ball, (1 + count(*) FILTER (abs(s.drift) >= abs(r.drift) - 1e-9)) / {1.0 + _RK} AS p_drift, (1 + count(*) FILTER (abs(s.momentum) >= abs(r.momentum) - 1e-9)) / {1.0 + _RK} AS p_momentum
        FROM v r JOIN v s ON r.sid % 1000 = 0 AND s.sid % 1000 > 0 AND r.sid // 1000 = s.sid // 1000 AND r.colour = s.colour AND r.ball = s.ball GROUP BY ALL),
  k AS (SELECT w, p_drift, p_momentum, count(*) OVER (PARTITION BY w) AS n, row_number() OVER (PARTITION BY w ORDER BY p_drift) AS kd, row_number() OVER (PARTITION BY w ORDER BY p_momentum) AS km FROM p),
  q AS (SELECT w, CAST(least(min(p_drift * n / kd), min(p_momentum * n / km)) < .05 AS INTEGER) AS sig FROM k GROUP BY w)
  SELECT count(*) AS n_windows, CAST(sum(sig) AS BIGINT) AS n_sig_windows, round(avg(sig), 6) AS frac_sig, CASE WHEN avg(sig) <= 1.5 * .05 THEN 'NULL' ELSE 'LOCAL_STRUCTURE' END AS verdict FROM q"""
)
def rolling_verdict(spark, sf_dir):
    d = derived(spark, sf_dir)
    return scans.rolling_verdict(d, d.count(), k=_RK, seed=7).select("n_windows", "n_sig_windows", r6(F.col("frac_sig")).alias("frac_sig"), "verdict")


@register(
    """WITH d AS (SELECT CAST(ts AS DATE) AS cycle, avg(value) AS best_q FROM events GROUP BY 1), l AS (SELECT best_q FROM d ORDER BY cycle DESC LIMIT 20)
  SELECT count(*) AS n, round(stddev_pop(best_q) / avg(best_q), 6) AS cv, round(quantile_cont(best_q, .75) - quantile_cont(best_q, .25), 6) AS iqr FROM l"""
)
def stability(spark, sf_dir):
    history = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("cycle")).agg(F.avg("value").alias("best_q"))
    return gates.stability(history).select("n", r6(F.col("cv")).alias("cv"), r6(F.col("iqr")).alias("iqr"))


# ---- forecasts

_PICK = """p AS (SELECT colour, ball, row_number() OVER (PARTITION BY colour ORDER BY score DESC, ball) AS k FROM (SELECT colour, ball, round(sum(w), 9) AS score FROM (SELECT 'red' AS colour, unnest(reds) AS ball, w FROM u UNION ALL SELECT 'blue', blue, w FROM u) GROUP BY ALL))
  SELECT array_to_string(list(ball ORDER BY ball) FILTER (colour = 'red' AND k <= 6), ',') AS reds, CAST(max(ball) FILTER (colour = 'blue' AND k = 1) AS INTEGER) AS blue FROM p"""


def _picked(df):
    return df.select(F.array_join("reds", ",").alias("reds"), "blue")


@register(f"WITH {DRAWS}, n AS (SELECT count(*) AS n FROM draws), u AS (SELECT reds, blue, pow(.97, n - 1 - t) AS w FROM draws, n WHERE t >= n - 150), {_PICK}")
def recency_predict(spark, sf_dir):
    return _picked(forecast.recency(derived(spark, sf_dir)))


@register(f"WITH {DRAWS}, n AS (SELECT count(*) AS n FROM draws), u AS (SELECT reds, blue, pow(.97, t - greatest(0, n - 150)) AS w FROM draws, n WHERE t >= n - 150), {_PICK}")
def recency_predict_oldest(spark, sf_dir):
    return _picked(forecast.recency(derived(spark, sf_dir), compat=True))


@register(
    f"""WITH {DRAWS}, n AS (SELECT count(*) AS n FROM draws), g AS (SELECT t, reds, blue, greatest(list_max(list_transform(range(2, 7), lambda i: reds[i] - reds[i - 1])), reds[1] + 33 - reds[6]) AS v, n FROM draws, n),
  m AS (SELECT avg(v) AS regime FROM g WHERE t >= n - 30), c AS (SELECT g.* FROM g, m WHERE abs(v - regime) <= 1.6), f AS (SELECT * FROM c WHERE (SELECT count(*) FROM c) >= 20 UNION ALL SELECT * FROM g WHERE t >= n - 150 AND (SELECT count(*) FROM c) < 20),
  u AS (SELECT reds, blue, pow(.97, row_number() OVER (ORDER BY t DESC) - 1) AS w FROM f), {_PICK}"""
)
def regime_predict(spark, sf_dir):
    return _picked(forecast.regime(derived(spark, sf_dir)))


_HITS = f"""{DRAWS}, n AS (SELECT count(*) AS n FROM draws), tg AS (SELECT t, reds, blue FROM draws, n WHERE t >= n - 500 AND t > 0),
  e AS (SELECT t, 'red' AS colour, unnest(reds) AS ball FROM draws UNION ALL SELECT t, 'blue', blue FROM draws),
  sc AS (SELECT tg.t, colour, ball, round(sum(pow(.97, tg.t - e.t - 1)), 9) AS score FROM tg JOIN e ON e.t < tg.t AND e.t >= tg.t - 150 GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY t, colour ORDER BY score DESC, ball) AS k FROM sc),
  hits AS (SELECT tg.t, count(*) FILTER (colour = 'red' AND k <= 6 AND list_contains(reds, ball)) AS red_hits, count(*) FILTER (colour = 'blue' AND k = 1 AND blue = ball) AS blue_hit FROM tg JOIN k USING (t) GROUP BY tg.t)"""


@register(f"WITH {_HITS} SELECT t, CAST(red_hits AS INTEGER) AS red_hits, CAST(blue_hit AS INTEGER) AS blue_hit FROM hits")
def backtest(spark, sf_dir):
    return forecast.backtest(derived(spark, sf_dir))


@register(f"WITH {_HITS} SELECT count(*) AS n, round(avg(red_hits), 6) AS mean_red_hits, round((avg(red_hits) - 36 / 33) / sqrt({6 * (6 / 33) * (27 / 33) * (27 / 32)} / count(*)), 6) AS z, round(avg(blue_hit), 6) AS blue_rate FROM hits")
def backtest_summary(spark, sf_dir):
    return forecast.backtest_summary(forecast.backtest(derived(spark, sf_dir))).select("n", *[r6(F.col(c)).alias(c) for c in ("mean_red_hits", "z", "blue_rate")])


@register(
    f"""WITH {DRAWS}, g AS (SELECT t, reds, blue, {SUM} AS v, (SELECT CAST(floor(count(*) * .8) AS BIGINT) FROM draws) AS cut FROM draws), tr AS (SELECT *, median(v) OVER () AS med FROM g WHERE t < cut),
  e AS (SELECT 'red' AS colour, unnest(reds) AS ball, v > med AS hi FROM tr UNION ALL SELECT 'blue', blue, v > med FROM tr),
  f AS (SELECT colour, ball, round(abs(count(*) FILTER (hi) / (SELECT count(*) FROM tr WHERE v > med) - count(*) FILTER (NOT hi) / (SELECT count(*) FROM tr WHERE v <= med)), 12) AS score FROM e GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY colour ORDER BY score DESC, ball) AS k FROM f), pr AS (SELECT list(ball) FILTER (colour = 'red' AND k <= 6) AS r, max(ball) FILTER (colour = 'blue' AND k = 1) AS b FROM k),
  te AS (SELECT DISTINCT reds, blue, cut FROM g WHERE t >= cut)
  SELECT max(cut) AS train_n, count(*) AS test_n, CAST(sum(len(list_intersect(reds, r))) AS BIGINT) AS red_hits, round(count(*) * 36 / 33, 6) AS red_expected, count(*) FILTER (blue = b) AS blue_hits, round(count(*) / 16, 6) AS blue_expected FROM te, pr"""
)
def pick_hits(spark, sf_dir):
    return forecast.pick_by_signal(derived(spark, sf_dir), "red_sum").select("train_n", "test_n", "red_hits", r6(F.col("red_expected")).alias("red_expected"), "blue_hits", r6(F.col("blue_expected")).alias("blue_expected"))


@register(
    f"""WITH {DRAWS}, g AS (SELECT t, reds, blue, {SUM} AS v, (SELECT CAST(floor(count(*) * .8) AS BIGINT) FROM draws) AS cut FROM draws), tr AS (SELECT * FROM g WHERE t < cut),
  o AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY md5('8:' || sid || ':' || t)) - 1 AS t, v FROM tr, range(0, 30) r(sid) UNION ALL SELECT -1, t, v FROM tr), md AS (SELECT median(v) AS med FROM tr),
  c AS (SELECT count(*) FILTER (v > med) AS hi, count(*) FILTER (v <= med) AS lo FROM tr, md), e AS (SELECT sid, 'red' AS colour, unnest(reds) AS ball, o.v > med AS hi FROM o JOIN tr USING (t), md UNION ALL SELECT sid, 'blue', blue, o.v > med FROM o JOIN tr USING (t), md),
  f AS (SELECT sid, colour, ball, round(abs(count(*) FILTER (e.hi) / max(c.hi) - count(*) FILTER (NOT e.hi) / max(c.lo)), 12) AS score FROM e, c GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY sid, colour ORDER BY score DESC, ball) AS k FROM f), te AS (SELECT DISTINCT reds, blue FROM g WHERE t >= cut),
  n AS (SELECT colour, ball, count(*) AS c FROM (SELECT 'red' AS colour, unnest(reds) AS ball FROM te UNION ALL SELECT 'blue', blue FROM te) GROUP BY ALL),
  h AS (SELECT sid, coalesce(sum(c), 0) AS h FROM k LEFT JOIN n USING (colour, ball) WHERE (colour = 'red' AND k <= 6) OR (colour = 'blue' AND k = 1) GROUP BY sid)
  SELECT CAST(max(r) AS BIGINT) AS hits, round(avg(h), 6) AS sur_mean, count(*) FILTER (h >= r) AS as_good, count(*) AS k_sur, round(least(1, (count(*) FILTER (h >= r) + .5) / count(*)), 6) AS p FROM h, (SELECT h AS r FROM h WHERE sid = -1) WHERE sid >= 0"""
)
def pick_accuracy(spark, sf_dir):
    out = forecast.pick_accuracy(derived(spark, sf_dir), "red_sum", k=30, seed=8)
    return out.select(F.col("hits").cast("long").alias("hits"), r6(F.col("sur_mean")).alias("sur_mean"), F.col("as_good").cast("long").alias("as_good"), "k_sur", r6(F.col("p")).alias("p"))


@register(
    f"""WITH {DRAWS}, n AS (SELECT count(*) AS n FROM draws), o AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY md5('4:' || sid || ':' || t)) - 1 AS t, reds FROM draws, range(0, 200) r(sid) UNION ALL SELECT -1, t, reds FROM draws),
  x AS (SELECT sid, t, ball, CAST(list_contains(reds, ball) AS INTEGER) AS x FROM o, range(1, 34) b(ball)),
  s AS (SELECT sid, t, ball, x, round(pow(.99, t - 1) * sum(x * pow(.99, -t)) OVER (PARTITION BY sid, ball ORDER BY t ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING), 9) AS score FROM x),
  k AS (SELECT sid, t, x, row_number() OVER (PARTITION BY sid, t ORDER BY score DESC, ball) AS k FROM s, n WHERE n > 320 AND t >= 300 AND t < n - 1),
  h AS (SELECT sid, count(DISTINCT t) AS n, sum(x) / count(DISTINCT t) / 6 AS rate FROM k WHERE k <= 6 GROUP BY sid),
  r AS (SELECT max(n) FILTER (sid = -1) AS n, max(rate) FILTER (sid = -1) AS hit FROM h), q AS (SELECT max(r.n) AS n, max(hit) AS hit, avg(rate) AS m, count(*) FILTER (rate >= hit) AS g, count(rate) AS k FROM r LEFT JOIN h ON sid >= 0)
  SELECT n, round(hit, 6) AS hit_rate, round(6 / 33.0, 6) AS random_rate, round(m, 6) AS sur_mean, CASE WHEN n IS NOT NULL THEN round((1 + g) / (1.0 + k), 6) END AS p_random, coalesce(hit > m AND (1 + g) / (1.0 + k) < .05, false) AS above_random FROM q"""
)
def walk_forward(spark, sf_dir):
    out = forecast.walk_forward(derived(spark, sf_dir), k=200, seed=4)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("hit_rate", "random_rate", "sur_mean", "p_random")], "above_random")


def _predictions(spark, sf_dir):
    """Methods `last` (the draw before), `third` (the draw three before) and a hashed baseline, for every draw."""
    d = derived(spark, sf_dir).select("t", "reds", "blue")
    fair = resampling.random_draws(spark, d.count(), 23)
    before = lambda k: d.select((F.col("t") + k).alias("issue"), F.lit({1: "last", 3: "third"}[k]).alias("method"), "reds", "blue")
    return before(1).union(before(3)).union(fair.select(F.col("t").alias("issue"), F.lit("random"), "reds", "blue"))


_PRED = f"""{DRAWS}, fk AS (SELECT t, ball, row_number() OVER (PARTITION BY t ORDER BY md5('23:' || t || ':' || ball)) AS n FROM draws, range(1, 34) r(ball)),
  pr AS (SELECT t + 1 AS issue, 'last' AS method, reds, blue FROM draws UNION ALL SELECT t + 3, 'third', reds, blue FROM draws UNION ALL
         SELECT t, 'random', list(CAST(ball AS INTEGER)), CAST(floor((CAST('0x' || substr(md5('23:' || t || ':blue'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 * 16) + 1 AS INTEGER) FROM fk WHERE n <= 6 GROUP BY t),
  sc AS (SELECT pr.issue, method, CASE WHEN d.t IS NOT NULL THEN CAST(len(list_intersect(pr.reds, d.reds)) AS INTEGER) END AS red_hit, (pr.blue = d.blue)::INTEGER AS blue_hit,
         CASE WHEN d.t IS NOT NULL THEN CASE WHEN len(list_intersect(pr.reds, d.reds)) = 6 THEN 0 ELSE {forecast.LOG_REDS!r} END END AS red_loss, CASE WHEN d.t IS NOT NULL THEN CASE WHEN pr.blue = d.blue THEN 0 ELSE {math.log(16)!r} END END AS blue_loss
         FROM pr LEFT JOIN draws d ON d.t = pr.issue)"""


def _scored(spark, sf_dir):
    actual = derived(spark, sf_dir).select(F.col("t").alias("issue"), "reds", "blue")
    return forecast.score(_predictions(spark, sf_dir), actual)


@register(f"WITH {_PRED} SELECT issue, method, red_hit, blue_hit, round(red_loss, 6) AS red_loss, round(blue_loss, 6) AS blue_loss FROM sc")
def score_predictions(spark, sf_dir):
    return _scored(spark, sf_dir).select("issue", "method", "red_hit", "blue_hit", r6(F.col("red_loss")).alias("red_loss"), r6(F.col("blue_loss")).alias("blue_loss"))


@register(
    f"""WITH {_PRED}, j AS (SELECT s.*, b.red_hit AS br FROM sc s LEFT JOIN sc b ON b.issue = s.issue AND b.method = 'random' WHERE s.method <> 'random' AND s.red_hit IS NOT NULL)
  SELECT method, count(*) AS n, CAST(sum(red_hit) AS BIGINT) AS red_hits, CAST(sum(blue_hit) AS BIGINT) AS blue_hits, round(avg(red_loss), 6) AS red_loss, round(avg(blue_loss), 6) AS blue_loss, round(avg(red_hit - coalesce(br, 0)), 6) + 0.0 AS mean_edge,
    count(*) FILTER (red_hit >= 1) AS any_red, count(*) FILTER (br >= 1) AS base_any_red, round((count(*) FILTER (red_hit >= 1) - count(*) FILTER (br >= 1)) / count(*), 6) + 0.0 AS edge FROM j GROUP BY method"""
)
def live_leaderboard(spark, sf_dir):
    out = forecast.leaderboard(_scored(spark, sf_dir))
    return out.select("method", "n", F.col("red_hits").cast("long"), F.col("blue_hits").cast("long"), *[r6(F.col(c)).alias(c) for c in ("red_loss", "blue_loss", "mean_edge")], F.col("any_red").cast("long"), F.col("base_any_red").cast("long"), r6(F.col("edge")).alias("edge"))


@register(
    f"""WITH {_PRED}, j AS (SELECT a.red_hit AS r, coalesce(a.blue_hit, 0) AS b, c.red_hit AS r0, coalesce(c.blue_hit, 0) AS b0 FROM sc a JOIN sc c ON a.issue = c.issue AND a.method = 'last' AND c.method = 'random' AND a.red_hit IS NOT NULL AND c.red_hit IS NOT NULL)
  SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS red_hits, round(avg(r), 6) AS mean_red, CAST(sum(r0) AS BIGINT) AS base_red_hits, round(avg(r0), 6) AS base_mean_red, CAST(sum(b) AS BIGINT) AS blue_hits, CAST(sum(b0) AS BIGINT) AS base_blue_hits, count(*) FILTER (r + b >= r0 + b0) AS no_worse FROM j"""
)
def scored_summary(spark, sf_dir):
    return forecast.scored_summary(_scored(spark, sf_dir), "last").withColumn("mean_red", r6(F.col("mean_red"))).withColumn("base_mean_red", r6(F.col("base_mean_red")))


@register(
    f"""WITH {_PRED}, known AS (SELECT * FROM pr WHERE issue % 2 = 0 OR method = 'last'), new AS (SELECT issue, method, blue FROM pr)
  SELECT issue, method, blue FROM known UNION ALL SELECT issue, method, blue FROM new n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.issue = n.issue AND k.method = n.method)"""
)
def register_predictions(spark, sf_dir):
    rows = _predictions(spark, sf_dir).select("issue", "method", "blue")
    return forecast.register(rows.where("issue % 2 = 0 or method = 'last'"), rows)


_RATE = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id"


def _user_counts(spark, sf_dir):
    hit = lambda kind: F.sum((F.col("event_type") == kind).cast("int"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), hit("click").alias("a"), hit("view").alias("b"))


@register(f"WITH c AS ({_RATE}), m AS (SELECT user_id, n, a / n AS p, 1 + 1.96 * 1.96 / n AS d FROM c) SELECT user_id, round(greatest(0, (p + 1.9208 / n) / d - 1.96 * sqrt(p * (1 - p) / n + .9604 / n / n) / d), 6) + 0.0 AS low, round(least(1, (p + 1.9208 / n) / d + 1.96 * sqrt(p * (1 - p) / n + .9604 / n / n) / d), 6) AS high FROM m")
def wilson(spark, sf_dir):
    low, high = forecast.wilson(F.col("a"), F.col("n"))
    return _user_counts(spark, sf_dir).select("user_id", r6(low).alias("low"), r6(high).alias("high"))


@register(f"WITH c AS ({_RATE}), m AS (SELECT *, (a + b) / (2 * n) AS p FROM c), z AS (SELECT user_id, (a - b) / n AS edge, CASE WHEN sqrt(p * (1 - p) * 2 / n) > 1e-12 THEN (a - b) / n / sqrt(p * (1 - p) * 2 / n) ELSE 0 END AS z FROM m) SELECT user_id, round(edge, 6) + 0.0 AS edge, round(z, 6) + 0.0 AS z FROM z")
def bernoulli_edge(spark, sf_dir):
    return forecast.edge(_user_counts(spark, sf_dir), "a", "b", "n").select("user_id", r6(F.col("edge")).alias("edge"), r6(F.col("z")).alias("z"))


_WILSON = "round((CASE WHEN {k} = 0 AND n = 0 THEN 0 ELSE greatest(0, ({k} / n + 1.9208 / n) / d - 1.96 * sqrt({k} / n * (1 - {k} / n) / n + .9604 / n / n) / d) END), 9)", "round(least(1, ({k} / n + 1.9208 / n) / d + 1.96 * sqrt({k} / n * (1 - {k} / n) / n + .9604 / n / n) / d), 9)"


@register(
    f"""WITH c AS ({_RATE}), m AS (SELECT *, (a + b) / (2 * n) AS p, 1 + 1.96 * 1.96 / n AS d FROM c), z AS (SELECT *, CASE WHEN sqrt(p * (1 - p) * 2 / n) > 1e-12 THEN abs(a - b) / n / sqrt(p * (1 - p) * 2 / n) / sqrt(2) ELSE 0 END AS x FROM m)
  SELECT user_id, round({_WILSON[0].format(k='a')} - {_WILSON[0].format(k='b')}, 6) + 0.0 AS edge_low, round({_WILSON[1].format(k='a')} - {_WILSON[1].format(k='b')}, 6) + 0.0 AS edge_high,
    round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda i: pow(-1, i) * pow(x, 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))), 6) + 0.0 AS p_two FROM z"""
)
def bernoulli_edge_p(spark, sf_dir):
    return forecast.edge(_user_counts(spark, sf_dir), "a", "b", "n").select("user_id", *[r6(F.col(c)).alias(c) for c in ("edge_low", "edge_high", "p_two")])


# ---- sources and records


@register(f"WITH {DRAWS}, m AS (SELECT * FROM draws WHERE t % 3 = 0 AND t < (SELECT count(*) // 2 FROM draws)), w AS (SELECT max(CAST(issue AS VARCHAR)) AS last FROM m) SELECT issue, blue FROM m UNION ALL SELECT issue, blue FROM draws, w WHERE CAST(issue AS VARCHAR) > last")
def incremental_append(spark, sf_dir):
    d = derived(spark, sf_dir)
    half = series.with_scalars(d, d.agg(F.floor(F.count(F.lit(1)) / 2).alias("half")))
    return draw_source.append_newer(half.where("t % 3 = 0 and t < half").select("issue", "blue"), d.select("issue", "blue"))


@register(f"WITH {DRAWS}, n AS (SELECT count(*) AS n FROM draws), l AS (SELECT string_agg(t || ',' || array_to_string(reds, ',') || ',' || blue, ';' ORDER BY t) AS s FROM draws, n WHERE t >= n - 60) SELECT n, substr(sha1(s), 1, 16) AS digest FROM n, l")
def data_fingerprint(spark, sf_dir):
    return draw_source.fingerprint(derived(spark, sf_dir))


@register("WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1)) AS r FROM pages), c AS (SELECT page_id, list_transform(regexp_extract_all(r, '(?is)<li\\b[^>]*>(.*?)</li>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g'))) AS c FROM r) SELECT page_id, CAST(len(c) AS INTEGER) AS n, array_to_string(c, '|') AS cells FROM c WHERE len(c) > 0")
def html_cells(spark, sf_dir):
    rows = draw_source.html_rows(table(spark, sf_dir, "pages").select("page_id", "html"), tag="ul", cell="li")
    return rows.select("page_id", F.size("cells").alias("n"), F.array_join("cells", "|").alias("cells"))


@register("SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 200")
def recent_runs(spark, sf_dir):
    from seqsieve.sources import logs

    return logs.recent(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), 200, "event_id")


def _states(spark, sf_dir):
    """A day of events as a cycle's state."""
    e = table(spark, sf_dir, "events").withColumn("cycle_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    n = F.count(F.lit(1))
    errors, clicks = F.sum((F.col("event_type") == "error").cast("int")), F.sum((F.col("event_type") == "click").cast("int"))
    return e.groupBy("cycle_id").agg(n.alias("n_eval"), (errors / n / 4).alias("best_q"), (clicks / n / 100).alias("best_p"), F.lit(0.05).alias("fdr_q"), (F.max("value") > 200).alias("alert"), F.when(clicks % 3 == 0, "SIGNAL").when(clicks % 3 == 1, "NULL").alias("wf_verdict"), (clicks % 4).alias("wf_n_confirm"), F.max(F.abs("value")).alias("max_abs_z"), (errors % 2).alias("n_artifact"), (clicks % 5 != 0).alias("control_verified"))


_STATE = """st AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS cycle_id, count(*) AS n_eval, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'click') AS c, max(value) > 200 AS alert, max(abs(value)) AS mz FROM events GROUP BY 1),
  s AS (SELECT cycle_id, n_eval, e / n_eval / 4 AS q, c / n_eval / 100 AS p, alert, CASE c % 3 WHEN 0 THEN 'SIGNAL' WHEN 1 THEN 'NULL' END AS wf, c % 4 AS nc, mz, e % 2 AS na, c % 5 <> 0 AS ok FROM st)"""
_LABELS = f"""{_STATE}, l AS (SELECT cycle_id, 'degenerate_stat' AS label FROM s WHERE mz > 1e6 UNION ALL SELECT cycle_id, 'boundary_artifact' FROM s WHERE na > 0 UNION ALL SELECT cycle_id, 'single_fold_fragile' FROM s WHERE wf = 'SIGNAL' AND nc < 2
  UNION ALL SELECT cycle_id, 'multiplicity_noise' FROM s WHERE q < .05 AND p > 1 / (n_eval + 1) UNION ALL SELECT cycle_id, 'null_honest' FROM s WHERE q >= .05 AND NOT alert AND wf IS DISTINCT FROM 'SIGNAL')"""


@register(f"WITH {_LABELS} SELECT cycle_id, label FROM l")
def failure_labels(spark, sf_dir):
    return governance.failure_labels(_states(spark, sf_dir)).select(F.col("cycle_id").cast("long"), "label")


@register(f"WITH {_LABELS} SELECT label, count(*) AS occurrences, max(cycle_id) AS last_seen, round(1 - pow(.9, count(*)), 4) AS avoid_weight FROM l WHERE label <> 'null_honest' GROUP BY label")
def taxonomy_prior(spark, sf_dir):
    return governance.avoidance_prior(governance.failure_labels(_states(spark, sf_dir))).withColumn("last_seen", F.col("last_seen").cast("long"))


@register("WITH n AS (SELECT event_type AS sig, count(*) AS n FROM events GROUP BY 1), t AS (SELECT *, round(least(2.0, 2 - n / (SELECT sum(n) FROM n)), 3) AS t FROM n) SELECT sig, n, CASE WHEN sig <> 'error' AND t > 1.05 THEN t END AS tilt, CASE WHEN sig = 'error' THEN .2 WHEN t > 1.05 THEN round(least(1.5, t), 3) ELSE 1 END::DOUBLE AS elite_bias FROM t")
def novelty_tilt(spark, sf_dir):
    fate = table(spark, sf_dir, "events").withColumnRenamed("event_type", "sig")
    return governance.novelty_tilt(fate, "sig", fate.where("sig = 'error'").select("sig").distinct())


@register(f"WITH {_STATE}, f AS (SELECT cycle_id, (q < .05 AND (p > 1 / (n_eval + 1) OR 1 - pow(1 - least(p, .999), n_eval) > .5))::INT + ((q < .05 OR alert) AND (wf IS NULL OR wf <> 'SIGNAL' OR nc < 2))::INT AS soft, (mz > 1e6)::INT + (NOT ok)::INT AS hard FROM s) SELECT cycle_id, CAST(soft + hard AS INTEGER) AS n_findings, CASE WHEN hard > 0 THEN 'ALERT' WHEN soft > 0 THEN 'REVIEW' ELSE 'OK' END AS verdict FROM f")
def red_team_audit(spark, sf_dir):
    return governance.audit(_states(spark, sf_dir)).withColumn("cycle_id", F.col("cycle_id").cast("long"))


@register("SELECT doc_id, CASE WHEN NOT (contains(lower(text), 'the ') OR contains(lower(text), 'der ')) THEN 'NONE' WHEN contains(lower(text), 'or ') OR contains(lower(text), 'oder ') THEN 'HEDGED' ELSE 'OVERCLAIM' END AS claim FROM documents")
def overclaims(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", governance.overclaims(F.col("text"), ["the ", "der "], ["or ", "oder "]).alias("claim"))


@register(f"WITH {DRAWS} SELECT t, issue, blue FROM draws WHERE t < (SELECT CASE WHEN floor(count(*) * .7) < 30 THEN greatest(1, count(*) - 30) ELSE floor(count(*) * .7) END FROM draws)")
def discovery_split(spark, sf_dir):
    return governance.discovery_part(derived(spark, sf_dir)).select("t", "issue", "blue")


@register(f"WITH {_USER_P}, e AS (SELECT user_id || ':' || event_type AS gkey, event_type IN ('click', 'view') AS high, round(p_raw * 10 - 5, 9) AS z FROM p) SELECT gkey, round(CASE WHEN high THEN z ELSE -z END, 6) + 0.0 AS extremity FROM e ORDER BY CASE WHEN high THEN z ELSE -z END DESC, gkey LIMIT 12")
def elites(spark, sf_dir):
    e = _user_p(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("gkey"), F.when(F.col("event_type").isin("click", "view"), "high").otherwise("low").alias("direction"), F.round(F.col("p_raw") * 10 - 5, 9).alias("z"))
    return governance.elites(e).select("gkey", r6(F.col("extremity")).alias("extremity"))


@register("SELECT DISTINCT user_id || ':' || event_type AS gkey FROM events WHERE user_id || ':' || event_type NOT IN (SELECT user_id || ':' || event_type FROM events WHERE value > 50)")
def untried(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("gkey", F.concat_ws(":", "user_id", "event_type"))
    return governance.untried(e.select("gkey").distinct(), e.where("value > 50").select("gkey"))


@register("WITH d AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS cycle_id, max(value) > 150 AS alert, avg(value) AS best_q, list(DISTINCT event_type) FILTER (value > 140) AS prone FROM events GROUP BY 1), l AS (SELECT * FROM d ORDER BY cycle_id DESC LIMIT 24) SELECT count(*) AS n, max(cycle_id) AS last_cycle, round(arg_max(best_q, cycle_id), 6) AS best_q, count(*) FILTER (alert) AS alerts, coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT unnest(prone) AS p FROM l)), '') AS artifacts FROM l")
def digest_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cycle_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long"))
    history = e.groupBy("cycle_id").agg((F.max("value") > 150).alias("alert"), F.avg("value").alias("best_q"), F.collect_set(F.when(F.col("value") > 140, F.col("event_type"))).alias("artifact_prone"))
    return gates.digest(history).withColumn("best_q", r6(F.col("best_q"))).withColumn("alerts", F.col("alerts").cast("long"))


@register(
    f"""WITH {_USER_P}, f AS (SELECT CAST(user_id AS VARCHAR) AS sig, event_type AS test, p_raw AS disc_p, CASE user_id % 4 WHEN 0 THEN 'SIGNAL' WHEN 1 THEN 'UNCONFIRMED' WHEN 2 THEN 'NULL' END AS wf_verdict FROM p),
  g AS (SELECT *, CASE WHEN wf_verdict IN ('SIGNAL', 'UNCONFIRMED') THEN wf_verdict WHEN disc_p < .05 THEN 'UNCONFIRMED' ELSE 'NULL' END AS gate FROM f)
  SELECT sig, test, gate, CAST(row_number() OVER (ORDER BY CASE gate WHEN 'SIGNAL' THEN 0 WHEN 'UNCONFIRMED' THEN 1 ELSE 2 END, disc_p, sig, test) AS INTEGER) AS place FROM g"""
)
def formula_records(spark, sf_dir):
    kind = F.col("user_id") % 4
    found = _user_p(spark, sf_dir).select(F.col("user_id").cast("string").alias("sig"), F.col("event_type").alias("test"), F.col("p_raw").alias("disc_p"), F.when(kind == 0, "SIGNAL").when(kind == 1, "UNCONFIRMED").when(kind == 2, "NULL").alias("wf_verdict"))
    return governance.formula_records(found).select("sig", "test", "gate", "place")


@register(
    f"""WITH {_STATE}, x AS (SELECT cycle_id, q AS best_q, p * 10 AS spectral_q, CASE WHEN nc = 1 THEN 1.0 ELSE .5 END AS hit, CASE WHEN na = 1 THEN 1.0 ELSE .4 END AS sm, CASE WHEN wf IS NULL THEN .97 ELSE .3 END AS op, n_eval AS op_n, nc > 1 AS above, ok AS cc FROM s),
  d AS (SELECT *, avg(best_q) OVER w AS m, count(best_q) OVER w AS c FROM x WINDOW w AS (ORDER BY cycle_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT cycle_id, CAST(3 * (hit = 1 AND sm >= .99 AND op >= .95)::INT + (op_n < 30)::INT + 3 * (hit >= .99 AND op >= .95)::INT + (op_n < 30)::INT + (c >= 3 AND abs(best_q - m) > .15)::INT + 2 * (best_q < .05 AND cc AND NOT above)::INT + 2 * (best_q >= .05 AND spectral_q < .01)::INT AS INTEGER) AS score FROM d"""
)
def self_check(spark, sf_dir):
    s = _states(spark, sf_dir)
    hit = F.when(F.col("wf_n_confirm") == 1, 1.0).otherwise(0.5)
    p = F.when(F.col("wf_verdict").isNull(), 0.97).otherwise(0.3)
    state = s.select(F.col("cycle_id").cast("long").alias("cycle_id"), "best_q", (F.col("best_p") * 10).alias("spectral_q"), hit.alias("hit_rate"), F.when(F.col("n_artifact") == 1, 1.0).otherwise(0.4).alias("sur_mean"), p.alias("oos_p"), F.col("n_eval").alias("oos_n"), (F.col("wf_n_confirm") > 1).alias("above_random"), F.col("control_verified").alias("cross_consistent"), p.alias("oot_p"), hit.alias("oot_hit"), F.col("n_eval").alias("oot_n"))
    return governance.self_check(state).select("cycle_id", "score")


@register(
    f"""WITH {_USER_P}, e AS (SELECT user_id || ':' || event_type AS gkey, event_type AS family, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END * round(p_raw * 10 - 5, 9) AS x FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY x DESC, gkey) AS k FROM e)
  SELECT gkey, family, round(x, 6) + 0.0 AS extremity FROM k WHERE k <= 3 ORDER BY x DESC, gkey LIMIT 12"""
)
def diverse_elites(spark, sf_dir):
    e = _user_p(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("gkey"), F.col("event_type").alias("family"), F.when(F.col("event_type").isin("click", "view"), "high").otherwise("low").alias("direction"), F.round(F.col("p_raw") * 10 - 5, 9).alias("z"))
    return governance.diverse(e).select("gkey", "family", r6(F.col("extremity")).alias("extremity"))


@register(
    f"""WITH {_USER_P}, a AS (SELECT user_id || ':' || event_type AS gkey, 'f' || (user_id % 3) AS fingerprint, 40 AS k, 'shuffle' AS null_type, 0 AS seed, p_raw FROM p), c AS (SELECT gkey, fingerprint, k, null_type, CAST(length(gkey) % 2 AS INTEGER) AS seed, p_raw FROM a)
  SELECT gkey, true AS hit, round(p_raw, 6) AS p_raw FROM c WHERE seed = 0 UNION ALL SELECT gkey, false, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.gkey = a.gkey AND c.seed = a.seed)"""
)
def eval_cache(spark, sf_dir):
    asked = _user_p(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("gkey"), F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("fingerprint"), F.lit(40).alias("k"), F.lit("shuffle").alias("null_type"), F.lit(0).alias("seed"), "p_raw")
    hits, misses = governance.cached(asked.drop("p_raw"), asked.withColumn("seed", (F.length("gkey") % 2).cast("int")))
    return hits.select("gkey", F.lit(True).alias("hit"), r6(F.col("p_raw")).alias("p_raw")).union(misses.select("gkey", F.lit(False), F.lit(None).cast("double")))


@register(
    """WITH o AS (SELECT event_id AS op_id, CASE event_type WHEN 'click' THEN 'absorb' WHEN 'view' THEN 'propose' ELSE 'correct_bias' END AS kind, CASE WHEN user_id % 5 = 0 THEN [] WHEN user_id % 5 = 1 THEN ['made_up'] ELSE ['ingest_fate', 'failure_taxonomy'] END AS src,
    CASE WHEN user_id % 3 = 0 THEN ['sigmap_injection'] ELSE ['nowhere'] END AS snk, CASE WHEN event_type = 'error' THEN ['train_auc', 'bh_fdr_q'] ELSE ['bh_fdr_q'] END AS used, CASE WHEN value > 100 THEN 'backtest_fit' END AS aim FROM events),
  f AS (SELECT op_id, (len(src) = 0)::INT + len(list_filter(src, lambda x: x = 'made_up')) + CASE WHEN kind <> 'propose' THEN len(list_filter(snk, lambda x: x = 'nowhere')) ELSE 0 END + len(list_filter(used, lambda x: x = 'train_auc')) + coalesce((aim = 'backtest_fit')::INT, 0) AS n FROM o)
  SELECT op_id, CAST(n AS INTEGER) AS n_findings, CASE WHEN n > 0 THEN 'ALERT' ELSE 'OK' END AS verdict FROM f"""
)
def learning_audit(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "absorb").when(F.col("event_type") == "view", "propose").otherwise("correct_bias")
    texts = lambda *names: F.array(*map(F.lit, names))
    fifth = F.col("user_id") % 5
    src = F.when(fifth == 0, F.array().cast("array<string>")).when(fifth == 1, texts("made_up")).otherwise(texts("ingest_fate", "failure_taxonomy"))
    snk = F.when(F.col("user_id") % 3 == 0, texts("sigmap_injection")).otherwise(texts("nowhere"))
    used = F.when(F.col("event_type") == "error", texts("train_auc", "bh_fdr_q")).otherwise(texts("bh_fdr_q"))
    ops = table(spark, sf_dir, "events").select(F.col("event_id").alias("op_id"), kind.alias("kind"), src.alias("input_sources"), snk.alias("output_sinks"), used.alias("used_feedback"), F.when(F.col("value") > 100, "backtest_fit").alias("objective"))
    return governance.learning_audit(ops)


@register(f"WITH {_STATE} SELECT cycle_id, round(q, 6) AS best_q, round(avg(q) OVER (ORDER BY cycle_id ROWS 4 PRECEDING), 6) AS moving, round(q - lag(q) OVER (ORDER BY cycle_id), 6) + 0.0 AS change FROM s")
def trend(spark, sf_dir):
    out = governance.trend(_states(spark, sf_dir).withColumn("cycle_id", F.col("cycle_id").cast("long")))
    return out.select("cycle_id", *[r6(F.col(c)).alias(c) for c in ("best_q", "moving", "change")])


@register(f"WITH {_STATE} SELECT count(*) AS cycles, round(arg_max(q, cycle_id), 6) AS last_q, round(min(q), 6) AS least_q, CAST(sum(n_eval) AS BIGINT) AS evaluations, count(*) FILTER (alert) AS alerts, round(avg(CASE WHEN wf = 'SIGNAL' THEN 1 ELSE 0 END), 6) AS signal_share FROM s")
def kpi(spark, sf_dir):
    out = governance.kpi(_states(spark, sf_dir))
    return out.select("cycles", r6(F.col("last_q")).alias("last_q"), r6(F.col("least_q")).alias("least_q"), "evaluations", F.col("alerts").cast("long").alias("alerts"), r6(F.col("signal_share")).alias("signal_share"))


@register(f"WITH {_USER_P}, k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_raw, user_id, event_type) AS k FROM p), q AS (SELECT user_id || ':' || event_type AS gkey, p_raw, min(least(1, p_raw * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM k) SELECT gkey, round(p_raw, 6) AS p_raw, round(q, 6) AS q FROM q ORDER BY round(q, 12), round(p_raw, 12), gkey LIMIT 20")
def top_evaluations(spark, sf_dir):
    rows = evaluation.bh_fdr(_user_p(spark, sf_dir)).select(F.concat_ws(":", "user_id", "event_type").alias("gkey"), F.round("p_raw", 12).alias("p_raw"), F.round("q", 12).alias("q"))
    return governance.leaderboard(rows).select("gkey", r6(F.col("p_raw")).alias("p_raw"), r6(F.col("q")).alias("q"))


@register("WITH c AS (SELECT user_id % 7 AS seed, event_type AS sig, CAST(user_id % 3 AS VARCHAR) AS test, 'p' || (event_id % 5) AS params, round(value / 1000, 6) AS p_raw FROM events) SELECT sig, test, params, min(p_raw) AS p_raw, count(DISTINCT seed) AS seeds FROM c GROUP BY ALL")
def merged_candidates(spark, sf_dir):
    from seqsieve.sources import logs

    e = table(spark, sf_dir, "events")
    p = F.round(F.col("value") / 1000, 6)
    rows = e.select((F.col("user_id") % 7).alias("seed"), F.col("event_type").alias("sig"), (F.col("user_id") % 3).cast("string").alias("test"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("params"), p.alias("p_raw"), p.alias("z"), F.lit("light").alias("tier"))
    return logs.merged(rows).select("sig", "test", "params", "p_raw", "seeds")


@register("WITH r AS (SELECT CAST(ts AS DATE) AS d, user_id, event_type, (1 + count(*) FILTER (value > 50)) / (1.0 + count(*)) AS p FROM events GROUP BY ALL) SELECT user_id, event_type, round(p, 6) AS p_raw FROM r WHERE d = (SELECT max(d) FROM r)")
def latest_p(spark, sf_dir):
    from seqsieve.sources import logs

    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run_id"), "user_id", "event_type").agg(((1 + F.sum((F.col("value") > 50).cast("int"))) / (1 + F.count(F.lit(1)))).alias("p_raw"))
    return logs.latest(e, "run_id").select("user_id", "event_type", r6(F.col("p_raw")).alias("p_raw"))


@register("WITH n AS (SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY event_type) AS BIGINT) AS id, event_type, n, round(total, 4) AS total FROM n WHERE event_type < 'm' UNION ALL SELECT (SELECT count(*) FROM n WHERE event_type < 'm') + row_number() OVER (ORDER BY event_type), event_type, n, round(total, 4) FROM n WHERE event_type >= 'm'")
def run_tables(spark, sf_dir):
    """Two appends to a run table, with ids that go on."""
    from seqsieve.sources import logs

    runs = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    logs.append_numbered(runs.where("event_type < 'm'"), path, "event_type")
    logs.append_numbered(runs.where("event_type >= 'm'"), path, "event_type")
    return spark.read.parquet(path)


@register(f"WITH {DRAWS} SELECT lpad(CAST(issue AS VARCHAR), 9, '0') AS issue, reds[1] AS r1, reds[6] AS r6, blue FROM draws WHERE blue <> 13")
def csv_snapshot(spark, sf_dir):
    """Draws written as CSV text, some of them spoilt, refreshed to a clean snapshot in order, and read back."""
    d = derived(spark, sf_dir).withColumn("issue", F.lpad(F.col("issue").cast("string"), 9, "0"))
    raw, clean = (f"{shared_dir(spark)}/csv-{k}-{uuid.uuid4().hex}" for k in ("raw", "clean"))
    draw_source.flat(d).withColumn("b", F.when(F.col("b") == 13, "x").otherwise(F.col("b").cast("string"))).write.csv(raw, header=True)
    draw_source.refresh(spark, raw, clean)
    return draw_source.read_csv(spark, clean, strict=True).select("issue", F.element_at("reds", 1).alias("r1"), F.element_at("reds", 6).alias("r6"), "blue")


@register("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (user_id, event_type)")
def rollup_types(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- search


@register()
def evolve(spark, sf_dir):
    """Two epochs of the default population over all draws and all tests of one series; the rows are the evaluations."""
    evals, _ = search.evolve(derived(spark, sf_dir), epochs=2, seed=1, k_light=20, k_heavy=10)
    names = ("sig", "test", "params", "gkey", "direction", "stat", "z", "p_raw", "k_sur")
    return spark.createDataFrame([tuple(e[n] for n in names) for e in evals], "sig string, test string, params string, gkey string, direction string, stat double, z double, p_raw double, k_sur long")


@register()
def tune_knobs(spark, sf_dir):
    best, top = search.tune(derived(spark, sf_dir), "red_sum", "acf_max", k=20, steps=2, anchors=6, seed=1)
    return spark.createDataFrame([("red_sum", "acf_max", str(sorted(best.items())), float(top))], "sig string, test string, knobs string, z double")


# ---- streams

_DAY = 86_400_000_000


@register(f"SELECT CAST(epoch_us(ts) // {_DAY} * {_DAY} AS BIGINT) AS start_us, CAST(epoch_us(ts) // {_DAY} * {_DAY} + {_DAY} AS BIGINT) AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """The same job on a stream of the table: all that is available, complete mode."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return jobs.run_available(jobs.windowed(stream, "tumbling"), f"{shared_dir(spark)}/tumbling-{uuid.uuid4().hex}", "complete").withColumn("total", F.round("total", 4))


@register(f"WITH w AS (SELECT epoch_us(ts) // {_DAY // 2} * {_DAY // 2} - k * {_DAY // 2} AS s, value FROM events, range(0, 2) r(k)) SELECT CAST(s AS BIGINT) AS start_us, CAST(s + {_DAY} AS BIGINT) AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def window_sliding(spark, sf_dir):
    return jobs.windowed(table(spark, sf_dir, "events"), "sliding").withColumn("total", F.round("total", 4))


@register("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def window_session(spark, sf_dir):
    return jobs.windowed(table(spark, sf_dir, "events"), "session").withColumn("total", F.round("total", 4))



# Candidates of the ledger: customers, those of even segments with a verdict after them, in two appends; one entry is changed later.
_LEDGER = """e AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS o, 'candidate' AS kind, c_name AS gkey, c_mktsegment AS source, CAST(NULL AS VARCHAR) AS fingerprint, CAST(c_nationkey AS BIGINT) AS seed, CAST(NULL AS VARCHAR) AS label, c_acctbal > 0 AS passed, CAST(NULL AS VARCHAR) AS verdict FROM customer),
  v AS (SELECT n + row_number() OVER (ORDER BY c_custkey) - 1 AS o, 'verdict' AS kind, c_name AS gkey, NULL AS source, NULL AS fingerprint, NULL AS seed, NULL AS label, NULL AS passed, CASE WHEN c_nationkey % 2 = 0 THEN 'SIGNAL' ELSE 'NULL' END AS verdict FROM customer, (SELECT count(*) AS n FROM customer)),
  r AS (SELECT o AS seq, CASE WHEN kind = 'candidate' THEN o // 4096 ELSE (n + 4095) // 4096 + (o - n) // 4096 END AS block, gkey, kind, passed, verdict,
    sha256(o || concat(length(kind), ':', kind) || concat(length(gkey), ':', gkey) || coalesce(length(source) || ':' || source, '-') || '-' || coalesce(length(CAST(seed AS VARCHAR)) || ':' || seed, '-') || '-' || coalesce(length(CAST(passed AS VARCHAR)) || ':' || passed, '-') || coalesce(length(verdict) || ':' || verdict, '-') || '-') AS row_hash
    FROM (SELECT * FROM e UNION ALL SELECT * FROM v), (SELECT count(*) AS n FROM customer)),
  d AS (SELECT block, min(seq) AS first, count(*) AS n, sha256(string_agg(row_hash, '' ORDER BY seq)) AS digest FROM r GROUP BY block),
  h AS (SELECT block, sha256('|' || block || '|' || first || '|' || n || '|' || digest) AS hash FROM d WHERE block = 0 UNION ALL SELECT d.block, sha256(h.hash || '|' || d.block || '|' || d.first || '|' || d.n || '|' || d.digest) FROM h JOIN d ON d.block = h.block + 1)"""


def _ledger(spark, sf_dir):
    path = f"{shared_dir(spark)}/seqsieve-ledger-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer")
    ledger.append(c.select(F.col("c_custkey").alias("o"), F.lit("candidate").alias("kind"), F.col("c_name").alias("gkey"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("seed"), (F.col("c_acctbal") > 0).alias("passed")), path, "o")
    ledger.append(c.select(F.col("c_custkey").alias("o"), F.lit("verdict").alias("kind"), F.col("c_name").alias("gkey"), F.when(F.col("c_nationkey") % 2 == 0, "SIGNAL").otherwise("NULL").alias("verdict")), path, "o")
    return ledger.read(spark, path)


@register(f"WITH RECURSIVE {_LEDGER} SELECT seq, row_hash, hash AS block_hash, CASE WHEN seq = 7 THEN 'content' END AS why FROM r JOIN h USING (block)")
def audit_ledger(spark, sf_dir):
    """All entries, after one of them was made to say that it had passed, or had not."""
    rows, blocks = _ledger(spark, sf_dir)
    changed = rows.withColumn("passed", F.when(F.col("seq") == 7, ~F.col("passed")).otherwise(F.col("passed")))
    return ledger.verify(changed, blocks).join(blocks.select("block", F.col("hash").alias("block_hash")), "block").select("seq", "row_hash", "block_hash", "why")


@register(f"WITH RECURSIVE {_LEDGER}, s AS (SELECT c_name AS gkey, 'auditor ' || c_nationkey AS signed_by FROM customer WHERE c_custkey % 3 = 0) SELECT gkey, signed_by FROM s WHERE gkey IN (SELECT gkey FROM r WHERE kind = 'candidate' AND passed) AND gkey IN (SELECT gkey FROM r WHERE verdict = 'SIGNAL')")
def promotions(spark, sf_dir):
    signed = table(spark, sf_dir, "customer").select(F.col("c_name").alias("gkey"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("auditor "), F.col("c_nationkey").cast("string"))).alias("signed_by"))
    return ledger.promotable(*_ledger(spark, sf_dir), signed)


@register(
    f"""WITH {_USER_P}, a AS (SELECT user_id || ':' || event_type AS gkey, user_id, p_raw FROM p)
  SELECT gkey, CASE WHEN user_id % 3 = 0 THEN 'second' WHEN user_id % 2 = 0 THEN 'first' END AS writer FROM a"""
)
def shared_evaluations(spark, sf_dir):
    """What a search finds in the table after two writers; none for keys that neither wrote."""
    own = Evaluations(spark, f"{shared_dir(spark)}/seqsieve-evaluations-{uuid.uuid4().hex}")
    asked = _user_p(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("gkey"), "user_id", F.lit("f").alias("fingerprint"), F.lit(40).alias("k_light"), F.lit(20).alias("k_heavy"), F.lit("shuffle").alias("null_type"), F.lit(0).alias("seed"))
    own.append(asked.where("user_id % 2 = 0").withColumn("value", F.lit("first")))
    own.append(asked.where("user_id % 3 = 0").withColumn("value", F.lit("second")))
    own.compact()
    hits, misses = own.answers(asked.drop("user_id"))
    return hits.select("gkey", F.col("value").alias("writer")).unionByName(misses.select("gkey", F.lit(None).cast("string").alias("writer")))


@register()
def evolve_seeds(spark, sf_dir):
    """Three searches at once, and what they send on, merged."""
    found, _ = search.evolve_seeds(derived(spark, sf_dir), [1, 2, 3], epochs=2, pop=8, tests=["acf_max", "mi_max", "perm_entropy"], k_light=20)
    return logs.merged(search.seed_candidates(spark, found, below=1.1)).select("sig", "test", "params", r6(F.col("p_raw")).alias("p_raw"), r6(F.col("z")).alias("z"), "tier", "seeds")


@register()
def diff_search(spark, sf_dir):
    """The pool's templates, tuned together."""
    found = search.diff_search(derived(spark, sf_dir), k=20, steps=2, anchors=4, seed=2)
    rows = [(i, r["sig"], r["test"], json.dumps(r["params"], sort_keys=True), float(r["z"]), r["disc_p"]) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "place int, sig string, test string, params string, z double, disc_p double").withColumns({"z": r6(F.col("z")), "disc_p": r6(F.col("disc_p"))})


@register()
def proposed_signals(spark, sf_dir):
    """Expressions tried on the discovery part: a sum of cubes, a gap beside the blue ball, one of unknown columns."""
    own = {"p_cubes": "aggregate(reds, 0D, (a, x) -> a + x * x * x) % 97", "p_gap_blue": "(reds[1] - reds[0]) * blue", "p_unknown": "whites[0] + 1"}
    found = proposals.try_out(derived(spark, sf_dir), own, seed=3)
    return found.withColumns({c: r6(F.col(c)) for c in ("p_shuffle", "p_aaft", "p_marginal")})
