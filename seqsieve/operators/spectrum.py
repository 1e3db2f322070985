"""Fourier transforms of series of any length, the spectral peak, and surrogates made from spectra.

A series of at most `block` points is transformed by one task. A longer one, of N = n1 * n2 points, is written as a matrix of n1 rows
with t = n2 * t1 + t2: tasks take bundles of columns and transform them, turn each value by its own angle, one shuffle
transposes the matrix, and tasks take bundles of rows and transform these; value f1 + n1 * f2 comes from row f1. A task holds at
most about `block` values. Where N has no two factors that fit, the transform is a convolution with a chirp (Bluestein) of a
power of two that has.

Rows are (keys, n, t, re, im): n is the length of the series, t the place of a value or the number of a frequency. Places without a row
are zeros.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.sources.shared import written

#: Complex values that a task transforms together: 16 MB.
BLOCK = 1 << 20


def factors(n: int, block: int = BLOCK) -> tuple[int, int] | None:
    """(n1, n2) with n1 * n2 = n, the nearest to a square, or None if one would be larger than the block."""
    for small in range(math.isqrt(n), 0, -1):
        if n % small == 0:
            return (small, n // small) if n // small <= block else None
        if n // small > block:
            return None
    return None


def plan(n: int, block: int = BLOCK) -> tuple[int, int, int]:
    """(points that are transformed, n1, n2): n itself, or the power of two of the chirp's convolution."""
    if n <= block:
        return n, 1, n
    if (found := factors(n, block)) is not None:
        return n, *found
    bits = (2 * n - 2).bit_length()
    if 1 << (bits + 1) // 2 > block:
        raise ValueError(f"a series of {n} points needs a larger block than {block}")
    return 1 << bits, 1 << bits // 2, 1 << (bits + 1) // 2


def _turn(numerator: np.ndarray, n: int) -> np.ndarray:
    """exp(-2 pi i numerator / n), the fraction taken of whole numbers."""
    return np.exp(-2j * np.pi * ((numerator % n) / n))


def _square(t: np.ndarray, n: int) -> np.ndarray:
    """t * t modulo n of whole numbers below 2^40, without overflow."""
    low, high = t & 0xFFFFF, t >> 20
    out = high * high % n
    for part in (2 * high * low, low * low):
        out = ((out << 20) + part) % n
    return out


def _columns(table, names):
    return [table.column(c).to_numpy() for c in names]


def _schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keys)


def _applied(df: DataFrame, by: list, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(table) -> columns without the keys, for each group; the keys' values come back beside them."""

    def run(table):
        import pyarrow as pa

        made = fn(table)
        rows = len(next(iter(made.values())))
        own = {k: pa.repeat(table.column(k)[0], rows) for k in keys}
        return pa.table(own | {c: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for c, v in made.items()})

    return df.groupBy(*by).applyInArrow(run, _schema(df, keys) + schema)


def _ended(rows: DataFrame, by: list, keys: list[str], matrix_of, finish, schema: str) -> DataFrame:
    """The last step: spectra of rows of the matrix, handed to finish(n, frequencies, values) -> columns."""

    def run(table):
        n = int(table.column("n")[0].as_py())
        return finish(n, *matrix_of(table))

    return _applied(rows, by, keys, run, schema)


def _all(n: int, f: np.ndarray, x: np.ndarray) -> dict:
    return {"n": np.full(len(f), n), "t": f, "re": x.real.copy(), "im": x.imag.copy()}


_CHIRPED = ("t", "re", "im", "re2", "im2")
_ROWS = "n long, t long, re double, im double"


def transform(rows: DataFrame, keys: list[str], *, inverse: bool = False, block: int = BLOCK, finish=_all, schema: str = _ROWS) -> DataFrame:
    """The discrete Fourier transform of every series, as rows of the same form; inverse has the other sign and divides by n.

    finish(n, frequencies, values) -> columns of `schema` may keep less than all values; it is asked for stretches of a spectrum."""
    if inverse:
        turned = rows.withColumn("im", -F.col("im"))
        done = transform(turned, keys, block=block)
        made = done.withColumn("re", F.col("re") / F.col("n")).withColumn("im", -F.col("im") / F.col("n"))
        if finish is not _all:
            raise ValueError("finish is for forward transforms")
        return made
    longest = rows.agg(F.max("n")).first()[0] or 0
    if longest <= block:
        return _short(rows, keys, finish, schema)
    short = _short(rows.where(F.col("n") <= block), keys, finish, schema)
    return short.unionByName(_long(rows.where(F.col("n") > block), keys, block, finish, schema))


def _short(rows: DataFrame, keys: list[str], finish, schema: str) -> DataFrame:
    def whole(table):
        n, t = int(table.column("n")[0].as_py()), table.column("t").to_numpy()
        x = np.zeros(n, complex)
        re, im = _columns(table, ("re", "im"))
        x[t] = re + 1j * im
        return np.arange(n), np.fft.fft(x)

    return _ended(rows, keys, keys, whole, finish, schema)


def _long(rows: DataFrame, keys: list[str], block: int, finish, schema: str) -> DataFrame:
    def planned(batches):
        for pdf in batches:
            made = [plan(int(n), block) for n in pdf["n"]]
            yield pdf.assign(**{c: [m[k] for m in made] for k, c in enumerate(("m", "n1", "n2"))})

    lengths = rows.select("n").distinct().mapInPandas(planned, "n long, m long, n1 long, n2 long")
    rows = rows.select(*keys, "n", "t", "re", "im").join(lengths, "n")
    plain = _four_steps(rows.where("m = n"), keys, block, finish, schema)
    # Bluestein: with w(t) = exp(-pi i t^2 / n) the spectrum is w(f) times the convolution of x w and 1 / w.
    chirped, names = rows.where("m > n"), [*keys, "n", "m", "n1", "n2"]

    def times_chirp(batches):
        import pyarrow as pa

        for batch in batches:
            n, t, re, im = _columns(batch, ("n", "t", "re", "im"))
            x, zero = (re + 1j * im) * _turn(_square(t, 2 * n), 2 * n), np.zeros(len(t))
            values = [t, x.real.copy(), x.imag.copy(), zero, zero]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *map(pa.array, values)], [*names, *_CHIRPED])

    def chirp(batches):
        import pyarrow as pa

        for batch in batches:
            n, m, t = _columns(batch, ("n", "m", "t"))
            w, zero = _turn(_square(t, 2 * n), 2 * n).conj(), np.zeros(len(t))
            for keep, place in ((t >= 0, t), (t > 0, m - t)):
                values = [place, zero, zero, w.real.copy(), w.imag.copy()]
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *map(pa.array, values)], [*names, *_CHIRPED]).filter(pa.array(keep))

    head = _schema(chirped, keys) + "n long, m long, n1 long, n2 long, t long, re double, im double, re2 double, im2 double"
    every = chirped.groupBy(*names).agg(F.lit(1).alias("_one")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4096))))
    every = every.withColumn("t", F.explode(F.sequence(F.col("_s") * 4096, F.least(F.col("n"), (F.col("_s") + 1) * 4096) - 1))).select(*names, "t")
    wide = chirped.select(*names, "t", "re", "im").mapInArrow(times_chirp, head).unionByName(every.mapInArrow(chirp, head))

    def conjugate(_, f, x):
        return _all(0, f, x.conj())

    product = _four_steps(wide, keys, block, conjugate, _ROWS, extra=["n"]).drop("n").withColumnRenamed("_n", "n").join(lengths, "n")
    product = written(product.select(*keys, "n", "m", "n1", "n2", "t", "re", "im"), "chirp")

    def unchirped(m, f, x):
        return _all(m, f, x.conj() / m)

    back = _four_steps(product, keys, block, unchirped, _ROWS, extra=["n"]).drop("n").withColumnRenamed("_n", "n").where("t < n")

    def last(table):
        n, t = int(table.column("n")[0].as_py()), table.column("t").to_numpy()
        re, im = _columns(table, ("re", "im"))
        return finish(n, t, (re + 1j * im) * _turn(_square(t, 2 * n), 2 * n))

    return plain.unionByName(_applied(back.withColumn("_s", F.floor(F.col("t") / block)), [*keys, "_s"], keys, last, schema))


def _four_steps(rows: DataFrame, keys: list[str], block: int, finish, schema: str, extra: list[str] = ()) -> DataFrame:
    """Transforms of m = n1 * n2 points. With re2, im2 the product of both columns' spectra. extra: columns that come back as _name."""
    two = "re2" in rows.columns
    width = F.greatest(F.lit(1), F.floor(F.lit(block) / F.col("n1")))
    rows = rows.withColumn("_c", F.floor((F.col("t") % F.col("n2")) / width)).withColumns({f"_{c}": F.col(c) for c in extra})
    held = [*keys, *(f"_{c}" for c in extra)]

    def first(table):
        m, n1, n2, c = (int(table.column(x)[0].as_py()) for x in ("m", "n1", "n2", "_c"))
        wide, tall = max(1, block // n1), max(1, block // n2)
        begin = c * wide
        t, out = table.column("t").to_numpy(), []
        for pair in (("re", "im"), ("re2", "im2"))[: 1 + two]:
            x = np.zeros((n1, min(wide, n2 - begin)), complex)
            re, im = _columns(table, pair)
            some = (re != 0) | (im != 0)  # a place may have a row for each column
            x[t[some] // n2, t[some] % n2 - begin] = re[some] + 1j * im[some]
            x = np.fft.fft(x, axis=0)
            out.append(x * _turn(np.arange(n1)[:, None] * (begin + np.arange(x.shape[1]))[None, :], m))
        starts = range(0, n1, tall)
        made = {f"v{k}": [x[a : a + tall].tobytes() for a in starts] for k, x in enumerate(out)}
        return made | {"_r": list(range(len(starts))), "_c": [c] * len(starts)} | {x: [y] * len(starts) for x, y in (("n", m), ("n1", n1), ("n2", n2))}

    blocks = _applied(rows, [*held, "_c"], held, first, "v0 binary, " + "v1 binary, " * two + "_r long, _c long, n long, n1 long, n2 long")

    def second(table):
        n1, n2, r = (int(table.column(x)[0].as_py()) for x in ("n1", "n2", "_r"))
        wide, tall = max(1, block // n1), max(1, block // n2)
        rows_here, out = min(tall, n1 - r * tall), 1
        for name in ("v0", "v1")[: 1 + two]:
            x = np.zeros((rows_here, n2), complex)
            for c, data in zip(table.column("_c").to_pylist(), table.column(name)):
                x[:, c * wide : (c + 1) * wide] = np.frombuffer(data.as_buffer(), complex).reshape(rows_here, -1)
            out = out * np.fft.fft(x, axis=1)
        f = (r * tall + np.arange(rows_here))[:, None] + n1 * np.arange(n2)[None, :]
        return f.reshape(-1), out.reshape(-1)

    return _ended(blocks, [*held, "_r"], held, second, finish, schema)


def measured(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, x) as rows of transform()."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = df.select(*keys, "t", F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im"))
    rows = rows.join(n, keys) if keys else rows.crossJoin(F.broadcast(n))  # one row without keys
    return rows.select(*keys, "n", "t", "re", "im")


def fft_peak(df: DataFrame, keys: list[str], *, block: int = BLOCK) -> DataFrame:
    """(keys, stat): largest power of a frequency but zero, as a share of all of them; null below 8 points and for a constant
    series. Of a spectrum, only a maximum and a sum leave the tasks."""

    def peak(n, f, x):
        p = np.where((f > 0) & (f <= n // 2), np.abs(x) ** 2, 0.0)
        return {"top": [float(p.max(initial=0.0))], "total": [float(p.sum())], "n": [n]}

    mean = df.groupBy(*keys).agg(F.avg("x").alias("_m"))
    centred = (df.join(mean, keys) if keys else df.crossJoin(F.broadcast(mean))).withColumn("x", F.col("x") - F.col("_m"))
    parts = transform(measured(centred, keys), keys, block=block, finish=peak, schema="top double, total double, n long")
    one = parts.groupBy(*keys).agg(F.max("top").alias("top"), F.sum("total").alias("total"), F.max("n").alias("n"))
    return one.select(*keys, F.when((F.col("n") >= 8) & (F.col("total") > 0), F.col("top") / F.when(F.col("total") > 0, F.col("total"))).alias("stat"))


# ---- surrogates


def ranked(df: DataFrame, column: str, keys: list[str], name: str = "rank") -> DataFrame:
    """df with the 0-based rank of column (ties by t) within the keys. Rows are dealt by ranges, numbered within a task's
    sorted rows, and the numbers of a task's rows before it are added: no task sees a whole series."""
    rows = written(df, "values")  # ranges are found by a first pass
    dealt = rows.repartitionByRange(*keys, column, "t").sortWithinPartitions(*keys, column, "t")
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    parts = dealt.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")  # a row for each task of the writer
    parts = parts.select(*keys, "_part", (before - F.col("_first")).alias("_base"))
    return dealt.join(parts, [*keys, "_part"]).withColumn(name, F.col("_id") + F.col("_base")).drop("_id", "_part", "_base")


def by_rank(made: DataFrame, values: DataFrame, keys: list[str], also: list[str]) -> DataFrame:
    """made(keys, also, t, y) with x = the value of values(keys, rank, x) of y's rank."""
    places = ranked(made, "y", [*keys, *also])
    return places.join(values, [*keys, "rank"]).select(*keys, *also, "t", "x")


def randomised(df: DataFrame, k: int, seed: int, keys: list[str], *, rounds: int = 0, block: int = BLOCK) -> DataFrame:
    """(keys, sid, t, x): k surrogates of every series (keys, t, x) with about its amplitude spectrum and exactly its values.

    rounds = 0: random phases, MD5 of (seed, sid, frequency) as in resampling.turns; values by rank. Else a shuffle (that of
    resampling.shuffled) driven to the amplitude spectrum of x in so many rounds, values by rank in each."""
    from seqsieve.operators import resampling

    df = written(df.select(*keys, "t", F.col("x").cast("double").alias("x")), "series")
    if rounds:
        return _iterated(df, k, seed, keys, rounds, block)
    return _randomised(df, k, seed, keys, 0, block)


def _iterated(df: DataFrame, k: int, seed: int, keys: list[str], rounds: int, block: int) -> DataFrame:
    """A series of at most `block` points is a task's for each of its surrogates, a longer one goes by bundles where it can be a
    matrix (iterated.py), and else by rows."""
    import pyarrow as pa

    from seqsieve.operators import iterated, resampling

    def planned(batches):
        for batch in batches:
            way = ["short" if n <= block else "matrix" if factors(n, block) else "chirp" for n in batch.column("n").to_pylist()]
            yield batch.append_column("way", pa.array(way, pa.string()))

    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    n = written(n.mapInArrow(planned, _schema(n, keys) + "n long, way string"), "lengths")
    rows = df.join(n, keys) if keys else df.crossJoin(F.broadcast(n))  # one row without keys

    def whole(table):
        x, sid = np.empty(len(table)), int(table.column("sid")[0].as_py())
        x[table.column("t").to_numpy()] = table.column("x").to_numpy()
        return {"t": np.arange(len(x)), "x": resampling.iterated_surrogate(x, resampling.order_of(len(x), seed, sid), rounds)}

    ways, own = {r.way for r in n.select("way").distinct().collect()}, [*keys, "sid"]
    out = None
    for way in sorted(ways) or ["short"]:
        some = rows.where(F.col("way") == way).drop("way")
        if way == "short":
            made = _applied(some.withColumn("sid", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))), own, own, whole, "t long, x double")
        elif way == "matrix":
            made = iterated.long_surrogates(some, resampling.shuffled(some, k, seed, keys), keys, rounds, block)
        else:
            made = _randomised(some.select(*keys, "t", "x"), k, seed, keys, rounds, block)
        made = made.select(*own, "t", "x")
        out = made if out is None else out.unionByName(made)
    return out


def _randomised(df: DataFrame, k: int, seed: int, keys: list[str], rounds: int, block: int) -> DataFrame:
    from seqsieve.operators import resampling

    values = written(ranked(df, "x", keys).select(*keys, "rank", "x"), "ranks")
    half = F.col("t") <= F.floor(F.col("n") / 2)
    spectrum = transform(measured(df, keys), keys, block=block).where(half).select(*keys, "n", "t", F.hypot("re", "im").alias("amplitude"))
    # A frequency stands for itself and its mirror image, but for zero and the middle of an even length.
    spectrum = spectrum.withColumn("amplitude", F.col("amplitude") * F.when((F.col("t") == 0) | (2 * F.col("t") == F.col("n")), 1.0).otherwise(2.0))
    if not rounds:
        angle = F.when(F.col("t") == 0, 0.0).otherwise(2 * math.pi * resampling.unit(seed, F.col("sid"), F.col("t")))
        turned = spectrum.withColumn("sid", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_a", angle)
        return _values(turned.select(*keys, "sid", "n", "t", (F.col("amplitude") * F.cos("_a")).alias("re"), (F.col("amplitude") * F.sin("_a")).alias("im")), values, keys, block)
    spectrum = written(spectrum, "amplitudes")
    now = resampling.shuffled(df, k, seed, keys)
    own = [*keys, "sid"]
    for _ in range(rounds):
        phases = transform(measured(now, own), own, block=block).where(half)
        phases = phases.withColumn("_a", F.atan2("im", "re")).drop("re", "im").join(spectrum, [*keys, "n", "t"])
        now = written(_values(phases.select(*own, "n", "t", (F.col("amplitude") * F.cos("_a")).alias("re"), (F.col("amplitude") * F.sin("_a")).alias("im")), values, keys, block), "round")
    return now


def _values(half: DataFrame, values: DataFrame, keys: list[str], block: int) -> DataFrame:
    made = transform(half, [*keys, "sid"], inverse=True, block=block)
    return by_rank(made.select(*keys, "sid", "t", F.col("re").alias("y")), values, keys, ["sid"])
