"""Surrogate data: null versions of a series or of draws, keyed by (seed, sid), equal however the rows are partitioned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.operators import transforms


def order_key(seed: int, *parts: Column) -> Column:
    """MD5 of the parts as text: the same order in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffled(df: DataFrame, k: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """k uniform permutations (sid 0..k-1) of df's rows by t. Ranks are taken in 256 slices of the hash, so a permutation
    of a long series is not sorted in one task."""
    rows = df.withColumn("sid", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_h", order_key(seed, F.col("sid"), F.col("t"))).withColumn("_s", F.substring("_h", 1, 2))
    sums = rows.groupBy(*keys, "sid", "_s").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select(*keys, "sid", "_s", (F.sum("_n").over(Window.partitionBy(*keys, "sid").orderBy("_s")) - F.col("_n")).alias("_base"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "sid", "_s").orderBy("_h")))
    return rows.join(sums, [*keys, "sid", "_s"]).withColumn("t", (F.col("_base") + F.col("_k") - 1).cast("long")).drop("_h", "_s", "_k", "_base")


def subset_marginal(draws: DataFrame, k: int, seed: int) -> DataFrame:
    """Draws without memory: per draw six balls without replacement, weighted by their frequency (the six least of
    -ln(u)/weight), and a blue ball from its own marginal."""
    n = draws.agg(F.count(F.lit(1)).alias("n"))
    freq = draws.select(F.explode("reds").alias("ball")).groupBy("ball").agg(F.count(F.lit(1)).alias("w"))  # 33 rows
    freq = freq.agg(F.collect_list(F.struct("ball", "w")).alias("freq"))
    blue = draws.groupBy("blue").agg(F.count(F.lit(1)).alias("w")).agg(F.array_sort(F.collect_list(F.struct("blue", "w"))).alias("blues"))  # 16 rows
    rows = draws.select("t").withColumn("sid", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    for one in (freq, blue, n):
        rows = rows.join(F.broadcast(one.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")
    drawn = F.transform("freq", lambda p: F.struct((-F.ln(unit(seed, F.col("sid"), F.col("t"), p["ball"])) / p["w"]).alias("key"), p["ball"].alias("ball")))
    reds = F.array_sort(F.transform(F.slice(F.array_sort(drawn), 1, 6), lambda p: p["ball"]))
    point = unit(seed, F.col("sid"), F.col("t"), F.lit("blue")) * F.col("n")
    walk = F.aggregate("blues", F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("int").alias("ball")), lambda a, p: F.struct((a["cum"] + p["w"]).alias("cum"), F.when(a["ball"].isNull() & (point <= a["cum"] + p["w"]), p["blue"]).otherwise(a["ball"]).alias("ball")))
    return rows.select("sid", "t", reds.alias("reds"), walk["ball"].alias("blue"))


def unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: 13 hex digits."""
    return (F.conv(F.substring(order_key(seed, *parts), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def random_draws(spark, n: int, seed: int) -> DataFrame:
    """Fair draws: six of 33 balls by least hash, and a blue ball 1..16."""
    ball = F.sequence(F.lit(1), F.lit(33))
    hashed = F.transform(ball, lambda b: F.struct(order_key(seed, F.col("t"), b).alias("key"), b.alias("ball")))
    reds = F.array_sort(F.transform(F.slice(F.array_sort(hashed), 1, 6), lambda p: p["ball"]))
    blue = (F.floor(unit(seed, F.col("t"), F.lit("blue")) * 16) + 1).cast("int")
    return spark.range(n).select(F.col("id").alias("t"), reds.alias("reds"), blue.alias("blue"))


# ---- phase and neighbour surrogates of one packed series, in numpy inside a task; spectrum.randomised has long series


#: Rows that are hashed together: their words stay in a core's cache.
TOGETHER = 1 << 14


def digests(seed: int, sid: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last eight bytes as big-endian numbers) of the MD5s of the texts seed:sid:t, t from 0 to n - 1."""
    import hashlib

    head = f"{seed}:{sid}:".encode()
    high, low = np.empty(n, np.uint64), np.empty(n, np.uint64)
    if len(head) + len(str(n)) > 55:  # more than one block of MD5
        both = np.frombuffer(b"".join([hashlib.md5(head + str(t).encode()).digest() for t in range(n)]), ">u8").reshape(n, 2)
        return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)
    shifts = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
    sines = [int(abs(np.sin(i + 1.0)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
    start, many = 0, 1
    while start < n:  # t of the same number of digits
        end = min(n, 10**many)
        for lo in range(start, end, TOGETHER):
            t = np.arange(lo, min(end, lo + TOGETHER))
            block = np.zeros((len(t), 64), np.uint8)
            block[:, : len(head)] = np.frombuffer(head, np.uint8)
            for i in range(many):
                block[:, len(head) + many - 1 - i] = 48 + t // 10**i % 10
            block[:, len(head) + many] = 128
            block[:, 56:58] = np.array([(len(head) + many) * 8], "<u2").view(np.uint8)
            words = np.ascontiguousarray(block.view("<u4").T)
            begin = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
            a, b, c, d = (np.full(len(t), v, np.uint32) for v in begin)
            f, turn = np.empty_like(a), np.empty_like(a)
            for i in range(64):
                if i < 16:
                    np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
                    g = i
                elif i < 32:
                    np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
                    g = (5 * i + 1) % 16
                elif i < 48:
                    np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
                    g = (3 * i + 5) % 16
                else:
                    np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
                    g = 7 * i % 16
                np.add(a, f, a), np.add(a, words[g], a), np.add(a, np.uint32(sines[i]), a)
                np.left_shift(a, np.uint32(shifts[i]), turn), np.right_shift(a, np.uint32(32 - shifts[i]), a)
                np.bitwise_or(a, turn, a), np.add(a, b, a)
                a, b, c, d = d, a, b, c
            a, b, c, d = ((v + np.uint32(w)).byteswap().astype(np.uint64) for v, w in zip((a, b, c, d), begin))
            high[lo : lo + len(t)], low[lo : lo + len(t)] = a << np.uint64(32) | b, c << np.uint64(32) | d
        start, many = end, many + 1
    return high, low


def turns(n: int, seed: int, sid: int) -> np.ndarray:
    """Unit numbers for the frequencies 0 .. n // 2 of n points, whose angles are MD5s; 1 at frequency 0."""
    part = (digests(seed, sid, n // 2 + 1)[0] >> np.uint64(12)).astype(float)
    out = np.exp(2j * np.pi * (part + 0.5) / float(1 << 52))
    out[0] = 1
    return out


def ranked(keys: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """The places of unsigned keys in their order; equal ones by `then`, and by place. At most 2^24 keys: their places take the
    lower bits of what is sorted, and only keys that are equal in the upper bits are compared in full."""
    n, low = len(keys), np.uint64((1 << 24) - 1)
    if n > 1 << 24:
        return np.argsort(keys, kind="stable") if then is None else np.lexsort((then, keys))
    both = keys & ~low
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int32)
    both >>= np.uint64(24)
    same = both[1:] == both[:-1]
    if same.any():
        at = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        own = order[at]
        order[at] = own[np.lexsort((own, keys[own]) if then is None else (own, then[own], keys[own]))]
    return order


def ordered(y: np.ndarray) -> np.ndarray:
    """The places of numbers in their order, ties by place: doubles' bits, turned so that they compare as whole numbers."""
    bits = (y + 0.0).view(np.int64)
    turned = bits >> np.int64(63)
    turned &= np.int64((1 << 63) - 1)
    turned ^= bits
    return ranked(turned.view(np.uint64) ^ np.uint64(1 << 63))


def remapped(x: np.ndarray, y: np.ndarray, own: dict | None = None) -> np.ndarray:
    """The values of x in the order of y; ties by place. own remembers x's values in order."""
    own = {} if own is None else own
    if "sorted" not in own:
        own["sorted"] = np.sort(x)
    out = np.empty_like(own["sorted"])
    out[ordered(y)] = own["sorted"]
    return out


def phase_surrogate(x: np.ndarray, turn: np.ndarray, own: dict | None = None) -> np.ndarray:
    """Random phases under the amplitude spectrum, then the sorted values of x by rank. own remembers the spectrum."""
    own = {} if own is None else own
    if "centred" not in own:
        own["centred"] = np.abs(transforms.rfft(x - x.mean()))
    return remapped(x, transforms.irfft(own["centred"] * turn, len(x)), own)


def iterated_surrogate(x: np.ndarray, order: np.ndarray, rounds: int = 5, own: dict | None = None) -> np.ndarray:
    """A shuffle driven back to the amplitude spectrum of x, values kept by rank, for some rounds. own remembers the spectrum."""
    own = {} if own is None else own
    if "amplitude" not in own:
        own["amplitude"] = np.abs(transforms.rfft(x))
    y = x[order]
    for _ in range(rounds):
        turn = transforms.rfft(y)
        np.multiply(1j, np.angle(turn), turn)
        np.exp(turn, turn)
        turn *= own["amplitude"]
        y = remapped(x, transforms.irfft(turn, len(x)), own)
    return y


def twin_surrogate(x: np.ndarray, rng: np.random.Generator, m: int = 3, theiler: int = 1, neighbours: int = 10, table: np.ndarray | None = None) -> np.ndarray:
    """A walk that at each step jumps to the successor of one of the nearest states outside the Theiler window. table: the
    states' neighbours (neighbours.twin_table), which serve all walks of a series; a walk is linear in its length."""
    from seqsieve.operators.neighbours import twin_table

    table = twin_table(x, m, theiler, neighbours) if table is None else table
    if table is None:
        return rng.permutation(x)
    n, many = table.shape
    # Views of arrays, as lists of these would take tens of bytes a number.
    first, anew, picks = int(rng.integers(n)), memoryview(rng.integers(0, n, len(x))), memoryview(rng.integers(0, many, len(x)))
    near, at, walk = memoryview(np.ascontiguousarray(table).reshape(-1)), first, np.empty(len(x), np.int64)
    out = memoryview(walk)
    for i, pick in enumerate(picks):
        out[i] = at
        at = near[at * many + pick] + 1
        if at >= n:
            at = anew[i]
    return x[walk]


def order_of(n: int, seed: int, sid: int) -> np.ndarray:
    """The permutation of n rows that shuffled() makes of a series: place i takes the row order_of(...)[i]."""
    return ranked(*digests(seed, sid, n))


def surrogate(columns: list[np.ndarray], kind: str, seed: int, name: str, sid: int, orders: dict, own: dict | None = None) -> list[np.ndarray]:
    """A surrogate of a packed series; two columns are shuffled together. orders remembers permutations and phases of series of one
    length, own what a series' surrogates share: its spectrum, its values in order, its neighbour table. A surrogate without own
    stands alone, and what earlier ones needed is not kept."""
    import zlib

    if own is None:
        orders.clear()
        own = {}
    x = columns[0]
    if kind == "shuffle":
        return [c[_remembered(order_of, len(x), seed, sid, orders)] for c in columns]
    x = np.asarray(x, float)
    if kind == "twin":
        from seqsieve.operators.neighbours import twin_table

        if "table" not in own:
            own["table"] = twin_table(x)
        return [twin_surrogate(x, np.random.default_rng([seed, zlib.crc32(name.encode()), sid]), table=own["table"]), *columns[1:]]
    if kind == "aaft":
        return [phase_surrogate(x, _remembered(turns, len(x), seed, sid, orders), own), *columns[1:]]
    return [iterated_surrogate(x, _remembered(order_of, len(x), seed, sid, orders), own=own), *columns[1:]]


def _remembered(make, n: int, seed: int, sid: int, orders: dict):
    key = (make.__name__, n, seed, sid)
    if key not in orders:
        for old in [o for o in orders if o[:2] != key[:2]]:
            del orders[old]
        orders[key] = make(n, seed, sid)
    return orders[key]


def surrogate_series(packed: DataFrame, kind: str, k: int, seed: int, together: int | None = None) -> DataFrame:
    """packed(series_id string, x array<double>) to (series_id, sid, x): one row for each surrogate. A series goes to k /
    together tasks, each of which makes that many: sixteen walks from one neighbour table, or one surrogate of another kind."""
    import pandas as pd

    together = together or (16 if kind == "twin" else 1)

    def run(pdf):
        own: dict = {}
        name, part, x = pdf["series_id"].iloc[0], int(pdf["part"].iloc[0]), np.asarray(pdf["x"].iloc[0], float)
        sids = range(part * together, min(k, (part + 1) * together))
        return pd.DataFrame({"series_id": name, "sid": list(sids), "x": [surrogate([x], kind, seed, name, i, {}, own)[0] for i in sids]})

    rows = packed.select("series_id", F.explode(F.sequence(F.lit(0), F.lit((k - 1) // together))).alias("part"), "x")
    return rows.groupBy("series_id", "part").applyInPandas(run, "series_id string, sid int, x array<double>")
