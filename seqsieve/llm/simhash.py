"""SimHash fingerprints of word shingles, and near-duplicate groups by multi-index hashing.

Linking fingerprints at two or fewer differing bits. A fingerprint has two segments of 32 bits, high and low, and each
segment has a table of who holds which value. If two fingerprints differ in at most two bits, their high segments are
equal or their low ones differ in at most one bit. So the high table is asked for each own value (a Hamming ball of radius
zero), and the low table for the ball of radius one around the own value. Of two values a bit apart the one without the
bit asks, so a ball is its centre and the centre with each of its zero bits set: 16 rows on average. Table matches are
candidates, and the complete distance is verified.

A segment value held by more than `hot` fingerprints would pair up many. Its rows are looked up by (segment, value, other
segment) instead: askers a bit away enumerate the ball of radius one of their other segment, and holders of the same value
enumerate theirs, meet at its points and are linked to the least one there. At most 33 fingerprints share a point and all
are within two bits, so components are those of all pairs and the work stays linear.

Equal fingerprints are collapsed before, so copies cost one row.

Cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; a very long text is
fingerprinted whole, in bounded memory; rows with a null doc_id get a component like others but are never its id, unless no
row of it has an id (then null); repeated rows get equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import written


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = text.lower().split()
    if len(parts) <= words:
        return digest(b" ".join(parts), 42) if parts else 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    total, n = np.zeros(64, np.int64), len(parts) - words + 1
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        to = min(n, at + (1 << 16))
        values = np.array([digest(line[a:z], 42) for a, z in zip(starts[at:to], ends[at + words - 1 : to + words - 1])], "<u8")
        total += _bit_sums(values)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_sums(values: np.ndarray) -> np.ndarray:
    """How many of the values have each of the 64 bits. Eight byte columns, each counted by value and then by bit."""
    out = np.empty(64, np.int64)
    columns = values.view(np.uint8).reshape(-1, 8)
    if len(values) < 512:
        return np.unpackbits(columns, axis=1, bitorder="little").sum(0, dtype=np.int64)
    for k in range(8):
        out[8 * k : 8 * k + 8] = np.bincount(columns[:, k], minlength=256) @ _BITS
    return out


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def with_fingerprints(docs: DataFrame, *, words: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; fp has the fingerprint's 64 bits."""

    def run(batches):
        import pyarrow as pa

        from . import tokens

        tokens.kept(None)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text")):
                fps = np.array([fingerprint(t, words) for t in texts], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at : at + len(texts)], pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


LOW = (1 << 32) - 1


def _ball(value, zero_bits_only: bool = False):
    """array<long>: a 32-bit value and its neighbours a bit away, or only those with a bit more."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col(value).bitwiseXOR(bit(i)))
    return F.concat(F.array(value), F.filter(flips, lambda v: v > F.col(value)) if zero_bits_only else flips)


def links(fps: DataFrame, *, hot: int = 64) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints with two or fewer differing bits.

    fps (fp long, distinct) is read several times, so pass a written table. Segment values held more than `hot` times take
    the way by both segments; the result does not depend on `hot`.
    """
    tasks = max(1, -(-fps.count() // 20_000))
    parted = fps.select("fp", F.expr("shiftrightunsigned(fp, 32)").alias("high"), F.col("fp").bitwiseAND(F.lit(LOW)).alias("low"))
    side = lambda segment, value, other: F.struct(F.lit(segment).alias("segment"), F.col(value).alias("value"), F.col(other).alias("other"))
    table = parted.select("fp", F.explode(F.array(side(0, "high", "low"), side(1, "low", "high"))).alias("s")).select("s.*", "fp")
    # (segment, value asked for, own value, other, fp): the high segment's own value, the low segment's ball.
    spread = parted.repartition(tasks, "fp")
    asked = spread.select("fp", F.lit(0).alias("segment"), F.col("high").alias("value"), F.col("high").alias("own"), F.col("low").alias("other"))
    asked = asked.union(spread.select("fp", F.lit(1), F.explode(_ball("low", zero_bits_only=True)), "low", "high"))
    crowded = written(table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("segment", "value"), "crowded")
    calm, rest = asked, None
    if not crowded.isEmpty():
        here = crowded.withColumn("crowd", F.lit(True))
        marked = asked.join(here, ["segment", "value"], "left").join(here.select("segment", F.col("value").alias("own"), F.col("crowd").alias("own_crowd")), ["segment", "own"], "left")
        calm = marked.where("crowd is null and own_crowd is null")
        near = marked.where("(crowd or own_crowd) and value <> own").select("fp", "segment", "value", F.explode(_ball("other")).alias("other"))
        near = near.join(table.withColumnRenamed("fp", "b"), ["segment", "value", "other"]).select(F.col("fp").alias("a"), "b")
        same = table.join(here, ["segment", "value"]).select("fp", "segment", "value", F.explode(_ball("other")).alias("point"))
        first = same.groupBy("segment", "value", "point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        rest = near.union(same.join(first, ["segment", "value", "point"]).select("a", F.col("fp").alias("b")))
    met = calm.join(table.select("segment", "value", F.col("fp").alias("b")), ["segment", "value"]).where("value <> own or fp < b")
    pairs = met.select(F.col("fp").alias("a"), "b")
    if rest is not None:
        pairs = pairs.union(rest)
    return pairs.where("a <> b and bit_count(a ^ b) <= 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, *, words: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable."""
    rows = written(with_fingerprints(docs, words=words, text=text), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = written(connected_components(links(fps.select("fp"))), "roots")
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
