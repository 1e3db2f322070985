"""Iterated surrogates in bundles against the packed form, and draws gathered as bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqsieve.operators import iterated, resampling, spectrum
from seqsieve.sources import draws


@pytest.mark.parametrize("kind", ["few", "many", "one", "neighbours"])
def test_parts_hold_equal_values_in_order_of_place(kind):
    rng = np.random.default_rng(3)
    y = {"few": rng.integers(0, 3, 900), "many": rng.normal(size=900), "one": np.zeros(900), "neighbours": rng.integers(0, 40, 900)}[kind].astype(float)
    t = rng.permutation(900)
    some = np.sort(rng.integers(0, 900, 30))
    cuts = np.array(sorted((y[i], t[i]) for i in some))
    got = iterated.part_of(y, t, cuts[:, 0], cuts[:, 1].astype(np.int64))
    assert got.tolist() == [sum((a, b) <= (v, at) for a, b in cuts.tolist()) for v, at in zip(y.tolist(), t.tolist())]


def test_a_long_series_is_no_rows_between_its_rounds(spark, monkeypatch):
    """Lengths of an odd and of even numbers of rows, ties, and a length that one task takes; only the series and its values go by rows."""
    seen = []
    kept = spectrum.written
    for module in (spectrum, iterated):
        monkeypatch.setattr(module, "written", lambda df, label: seen.append((label, kept(df, label))) or seen[-1][1])
    rng = np.random.default_rng(4)
    data = {"odd": np.round(rng.normal(size=300), 1), "even": rng.normal(size=256) + 9, "ties": rng.integers(0, 3, 180).astype(float), "short": rng.normal(size=50)}
    rows = spark.createDataFrame([(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)], "series_id string, t long, x double")
    got = spectrum.randomised(rows, 2, 7, ["series_id"], rounds=2, block=64).toPandas()
    for name, x in data.items():
        for sid in (0, 1):
            own = got[(got.series_id == name) & (got.sid == sid)].sort_values("t")
            assert own.t.tolist() == list(range(len(x))) and np.allclose(own.x, resampling.iterated_surrogate(x, resampling.order_of(len(x), 7, sid), 2))
    rounds = [df for label, df in seen if label == "round"]
    assert len(rounds) == 2 and all(df.count() < 60 for df in rounds)


def test_bundles_of_a_long_series_have_bounds():
    for n in (1 << 22, 9_056_520, 10**9):
        n1, n2, wide, tall, size = iterated._layout(n, spectrum.BLOCK)
        assert n1 * n2 == n and max(wide * n1, tall * n2) <= spectrum.BLOCK and size <= spectrum.BLOCK and n / (wide * n1) < 2000


def test_draws_of_odd_keys(spark, tmp_path):
    """Keys below zero, nulls and repeats give the balls that sets give."""
    parts = {1: [1, 2, 3, 4, 5, 6, 7], 7: [-1, -2, -3, -32, -33, 5, 32, 5], 2: [-1, -2, -33, -32, 0, 5, 5, None], 3: [31, 32, 33, 64, 65, 66], 4: [None] * 7, 5: [1, 2, 3, 4, 5], 6: [-64, 64, -1, 1, -31, 31, 2**40]}
    spark.createDataFrame([(o, p) for o, many in parts.items() for p in many], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o) for o in parts], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("1995-01-01").cast("date")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.issue: r.reds for r in draws.derived(spark, str(tmp_path)).collect()}
    rest = lambda v: int(np.fmod(v, 33)) + 1
    sets = {o: sorted({rest(p) for p in many if p is not None}) for o, many in parts.items()}
    assert got == {o: b[:6] for o, b in sets.items() if len(b) >= 6}
