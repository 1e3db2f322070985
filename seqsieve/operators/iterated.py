"""Iterated surrogates of series that no task holds, in bundles of packed values.

A series of N = n1 * n2 points is a matrix with t = n2 * t1 + t2, and frequency f1 + n1 * f2. Tasks hold bundles of columns (t2) or of
rows (f1). In a round, columns are transformed and sent to rows; these are transformed, take the series' amplitudes under their own
phases, are transformed back and sent to columns, which ends as the surrogate's new order. Its values are dealt into parts at
quantiles of a sample, (value, t) pairs, so that equal values are parted too; a part sorts its own, takes the series' values of these ranks
and sends them to their columns. So a round is four shuffles of packed numbers. Series are real: rows beyond n1 // 2 are mirror images.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.operators import spectrum
from seqsieve.sources.shared import written

#: Bundles of a series, while none is below LEAST values or above a block; values of each that are looked at for quantiles.
BUNDLES, LEAST, LOOKED = 64, 1 << 16, 64


@lru_cache(64)
def _layout(n: int, block: int) -> tuple[int, int, int, int, int]:
    """(n1, n2, columns of a bundle, rows of a bundle, values of a part)."""
    n1, n2 = spectrum.factors(n, block)
    size = min(block, max(LEAST, n // BUNDLES))
    return n1, n2, max(1, size // n1), max(1, size // n2), size


def _doubles(value, kind=float) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _first(table, name: str) -> int:
    return int(table.column(name)[0].as_py())


def _to_rows(n: int, c: int, block: int, x: np.ndarray) -> dict:
    """A bundle of columns, transformed and turned, in a piece for each bundle of rows."""
    n1, n2, wide, tall, _ = _layout(n, block)
    x = np.fft.rfft(x, axis=0)
    x *= spectrum._turn(np.arange(len(x))[:, None] * (c * wide + np.arange(x.shape[1]))[None], n)
    starts = range(0, len(x), tall)
    return {"n": [n] * len(starts), "r": list(range(len(starts))), "c": [c] * len(starts), "v": [x[a : a + tall].tobytes() for a in starts]}


_PIECE = "n long, r long, c long, v binary"


def _rows_of(table, block: int) -> tuple[int, int, np.ndarray]:
    """(n, first row, spectrum) of a bundle of rows, whose phases are those of a real series."""
    n, r = _first(table, "n"), _first(table, "r")
    n1, n2, wide, tall, _ = _layout(n, block)
    x = np.zeros((min(tall, n1 // 2 + 1 - r * tall), n2), complex)
    for c, v in zip(table.column("c").to_pylist(), table.column("v")):
        x[:, c * wide : (c + 1) * wide] = _doubles(v, complex).reshape(len(x), -1)
    x = np.fft.fft(x, axis=1)
    for row, first, half in ((0, 1, (n2 - 1) // 2), (n1 // 2, 0, n2 // 2 if n1 % 2 == 0 else 0)):
        if half and 0 <= (at := row - r * tall) < len(x):  # a row that is its own mirror image
            x[at, n2 - half :] = x[at, first : first + half][::-1].conj()
    return n, r, x


def _rows_to_columns(table, amplitudes: np.ndarray, block: int) -> dict:
    n, r, x = _rows_of(table, block)
    n1, n2, wide, tall, _ = _layout(n, block)
    x = np.fft.ifft(np.exp(1j * np.angle(x)) * amplitudes.reshape(x.shape), axis=1)
    x *= spectrum._turn(-(r * tall + np.arange(len(x)))[:, None] * np.arange(n2)[None], n)
    starts = range(0, n2, wide)
    return {"n": [n] * len(starts), "r": [r] * len(starts), "c": list(range(len(starts))), "v": [np.ascontiguousarray(x[:, a : a + wide]).tobytes() for a in starts]}


def _columns_of(table, block: int) -> dict:
    """A bundle of columns transformed back, and some of its (value, t)."""
    n, c = _first(table, "n"), _first(table, "c")
    n1, n2, wide, tall, _ = _layout(n, block)
    x = np.zeros((n1 // 2 + 1, min(wide, n2 - c * wide)), complex)
    for r, v in zip(table.column("r").to_pylist(), table.column("v")):
        x[r * tall : (r + 1) * tall] = _doubles(v, complex).reshape(-1, x.shape[1])
    y = np.fft.irfft(x, n1, axis=0).reshape(-1)
    some = np.random.default_rng(c).integers(0, len(y), LOOKED)
    return {"n": [n], "c": [c], "y": [y.tobytes()], "some": [y[some].tobytes()], "at": [_places(n, c, block)[some].tobytes()]}


def _places(n: int, c: int, block: int) -> np.ndarray:
    """t of a bundle's values."""
    n1, n2, wide, *_ = _layout(n, block)
    return (n2 * np.arange(n1)[:, None] + np.arange(c * wide, min(n2, (c + 1) * wide))[None]).reshape(-1)


def _quantiles(table, block: int) -> dict:
    n = _first(table, "n")
    y, t = (np.concatenate([_doubles(v, kind) for v in table.column(name)]) for name, kind in (("some", float), ("at", np.int64)))
    order, parts = np.lexsort((t, y)), -(-n // _layout(n, block)[4])
    cut = order[np.arange(1, parts) * len(order) // parts]
    return {"cut": [y[cut].tobytes()], "cut_at": [t[cut].tobytes()]}


def part_of(y: np.ndarray, t: np.ndarray, cut: np.ndarray, cut_at: np.ndarray) -> np.ndarray:
    """How many of the cuts, ordered pairs, are not above (y, t)."""
    part, beyond = np.searchsorted(cut, y, "left"), np.searchsorted(cut, y, "right")
    same = np.flatnonzero(beyond > part)
    lows = part[same]
    for lo in np.unique(lows):
        own = same[lows == lo]
        part[own] = lo + np.searchsorted(cut_at[lo : beyond[own[0]]], t[own], "right")
    return part


def _bundled(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, n, c, t, v) of rows(keys, n, t, x): the packed values of each bundle of columns."""

    def numbered(batches):
        import pyarrow as pa

        for batch in batches:
            n, t = (batch.column(c).to_numpy() for c in ("n", "t"))
            c = np.empty(len(t), np.int64)
            for one in np.unique(n):
                _, n2, wide, *_ = _layout(int(one), block)
                c[n == one] = t[n == one] % n2 // wide
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c)], [*batch.schema.names, "c"])

    def packed(table):
        return {"n": [_first(table, "n")], "c": [_first(table, "c")], "at": [table.column("t").to_numpy().tobytes()], "v": [table.column("x").to_numpy().tobytes()]}

    rows = rows.select(*keys, "n", "t", "x")
    dealt = rows.mapInArrow(numbered, spectrum._schema(rows, keys) + "n long, t long, x double, c long")
    return spectrum._applied(dealt, [*keys, "c"], keys, packed, "n long, c long, at binary, v binary")


def _columns_to_rows(bundles: DataFrame, keys: list[str], block: int) -> DataFrame:
    def run(table):
        n, c = _first(table, "n"), _first(table, "c")
        n1, n2, wide, *_ = _layout(n, block)
        x = np.empty((n1, min(wide, n2 - c * wide)))
        for at, v in zip(table.column("at"), table.column("v")):
            t = _doubles(at, np.int64)
            x[t // n2, t % n2 - c * wide] = _doubles(v)
        return _to_rows(n, c, block, x)

    return spectrum._applied(bundles, [*keys, "c"], keys, run, _PIECE)


def _by_rank(columns: DataFrame, values: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Bundles of columns (keys, sid, n, c, y) with the values of values(keys, stretch, x) in their order, in a piece for each part."""
    own = [*keys, "sid"]
    cuts = spectrum._applied(columns.select(*own, "n", "some", "at"), own, own, lambda table: _quantiles(table, block), "cut binary, cut_at binary")
    rows = columns.select(*own, "n", "c", "y").join(F.broadcast(cuts), own)
    head = spectrum._schema(rows, own)

    def each(batches, fn, names):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n, c = _first(one, "n"), _first(one, "c")
                y, t = _doubles(one.column("y")[0]), _places(n, c, block)
                part = part_of(y, t, _doubles(one.column("cut")[0]), _doubles(one.column("cut_at")[0], np.int64))
                made = fn(n, c, y, t, part)
                held = [pa.array([one.column(k)[0].as_py()] * len(made[0]), one.schema.field(k).type) for k in own]
                yield pa.RecordBatch.from_arrays([*held, *map(pa.array, made)], [*own, *names])

    def counted(n, c, y, t, part):
        counts = np.bincount(part)
        there = np.flatnonzero(counts)
        return there, counts[there]

    def dealt(n, c, y, t, part):
        order = np.argsort(part, kind="stable")
        there, starts = np.unique(part[order], return_index=True)
        stops = [*starts[1:], len(order)]
        pick = [order[a:z] for a, z in zip(starts, stops)]
        return there, [n] * len(pick), [c] * len(pick), [t[p].tobytes() for p in pick], [y[p].tobytes() for p in pick]

    counts = rows.mapInArrow(lambda batches: each(batches, counted, ("part", "m")), head + "part long, m long").groupBy(*own, "part").agg(F.sum("m").alias("m"))
    # A row for each part.
    counts = written(counts.withColumn("base", F.sum("m").over(Window.partitionBy(*own).orderBy("part")) - F.col("m")), "parts")
    size = F.col("size")
    needed = counts.join(F.broadcast(values.select(*keys, "size").distinct()), keys) if keys else counts.crossJoin(F.broadcast(values.select("size").distinct()))
    needed = needed.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("base") / size), F.floor((F.col("base") + F.col("m") - 1) / size))))
    needed = needed.join(values.drop("size"), [*keys, "stretch"]).select(*own, "part", "base", "m", "size", "stretch", "x")
    pieces = rows.mapInArrow(lambda batches: each(batches, dealt, ("part", "n", "c", "at", "y")), head + "part long, n long, c long, at binary, y binary")

    def ordered(pieces, values):
        import pyarrow as pa

        at, y = [_doubles(v, np.int64) for v in pieces.column("at")], [_doubles(v) for v in pieces.column("y")]
        ends = np.cumsum([len(v) for v in at])
        base, size, taken = _first(values, "base"), _first(values, "size"), np.empty(ends[-1])
        for stretch, x in zip(values.column("stretch").to_pylist(), values.column("x")):
            x, begin = _doubles(x), stretch * size - base
            a, z = max(0, begin), min(len(taken), begin + len(x))
            taken[a:z] = x[a - begin : z - begin]
        out = np.empty_like(taken)
        out[np.lexsort((np.concatenate(at), np.concatenate(y)))] = taken
        starts = [0, *ends[:-1]]
        held = {k: pa.repeat(pieces.column(k)[0], len(at)) for k in own}
        return pa.table(held | {"n": pieces.column("n"), "c": pieces.column("c"), "at": pieces.column("at"), "v": pa.array([out[a:z].tobytes() for a, z in zip(starts, ends)])})

    return pieces.groupBy(*own, "part").cogroup(needed.groupBy(*own, "part")).applyInArrow(ordered, head + "n long, c long, at binary, v binary")


def long_surrogates(df: DataFrame, shuffled: DataFrame, keys: list[str], rounds: int, block: int) -> DataFrame:
    """(keys, sid, t, x): shuffled(keys, sid, n, t, x) driven in so many rounds to the amplitude spectrum of df(keys, n, t, x), with
    df's values by rank. Lengths are above one and have factors that fit the block."""
    own = [*keys, "sid"]

    def stretches(table):
        size = _first(table, "size")
        return {"stretch": [_first(table, "stretch")], "size": [size], "x": [np.sort(table.column("x").to_numpy()).tobytes()]}

    def sized(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = {n: _layout(n, block)[4] for n in set(batch.column("n").to_pylist())}
            yield batch.append_column("size", pa.array([sizes[n] for n in batch.column("n").to_pylist()], pa.int64()))

    lengths = df.select("n").distinct().mapInArrow(sized, "n long, size long")
    values = spectrum.ranked(df.join(F.broadcast(lengths), "n").select(*keys, "size", "t", "x"), "x", keys)
    values = values.withColumn("stretch", F.floor(F.col("rank") / F.col("size")))
    values = written(spectrum._applied(values, [*keys, "stretch"], keys, stretches, "stretch long, size long, x binary"), "values")

    def amplitude(table):
        n, r, x = _rows_of(table, block)
        return {"r": [r], "a": [np.abs(x).tobytes()]}

    amplitudes = _columns_to_rows(_bundled(df, keys, block), keys, block)
    amplitudes = written(spectrum._applied(amplitudes, [*keys, "r"], keys, amplitude, "r long, a binary"), "amplitudes")
    sids = shuffled.select("sid").distinct()  # each series has all of them
    amplitudes = amplitudes.crossJoin(F.broadcast(sids)).select(*own, "r", "a")
    bundles = _bundled(shuffled, own, block)
    head = spectrum._schema(bundles, own)

    def turned(pieces, amplitudes):
        import pyarrow as pa

        made = _rows_to_columns(pieces, _doubles(amplitudes.column("a")[0]), block)
        return pa.table({k: pa.repeat(pieces.column(k)[0], len(made["n"])) for k in own} | {k: pa.array(v) for k, v in made.items()})

    for _ in range(rounds):
        rows = _columns_to_rows(bundles, own, block).groupBy(*own, "r").cogroup(amplitudes.groupBy(*own, "r")).applyInArrow(turned, head + _PIECE)
        columns = spectrum._applied(rows, [*own, "c"], own, lambda table: _columns_of(table, block), "n long, c long, y binary, some binary, at binary")
        bundles = _by_rank(written(columns, "round"), values, keys, block)

    def opened(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                t, x = _doubles(one.column("at")[0], np.int64), _doubles(one.column("v")[0])
                yield pa.RecordBatch.from_arrays([*(pa.array([one.column(k)[0].as_py()] * len(t), one.schema.field(k).type) for k in own), pa.array(t), pa.array(x)], [*own, "t", "x"])

    return bundles.mapInArrow(opened, head + "t long, x double")
