"""Groups of texts whose sets of word shingles have a Jaccard similarity of `least` or more, by SimHash and multi-index hashing.

Two sets at similarity s have a cosine of 2s / (1 + s) at least, so each bit of their SimHash fingerprints differs with chance
acos(cosine) / pi, 0.15 at 0.8. 64 bits cannot tell such pairs from less similar ones, so fingerprints have `bits` bits here,
and the index has `tables` segments of `width` of these bits. Each fingerprint is looked up in each segment's table by its own
value (a Hamming ball of radius zero: many segments find more for each row of an index than balls around few). A pair at
similarity s meets in some table with chance 1 - (1 - (1 - p)^width)^tables, 0.95 at 0.8 and 0.99 at 0.84; the test holds recall to
brute force. Unlike texts that meet by chance grow with the square of their number over 2^width: for more than some ten million
texts, widen segments by a bit for each doubling, and take log(20) / (1 - p)^width tables.

Of table matches first the distance over 64 bits, then the complete distance is verified: at most the mean at `least` and 2.5
deviations. Each pair within is confirmed from its two texts. First every row is compared with the few least rows of its
buckets that it meets most often, so a large group of copies costs a few comparisons a member; then all pairs of a bucket
that are not yet in one component. So the components are those of all pairs that meet, though members of one component are not paired up. In buckets
of more than `crowd` members a pair is made in its first common table only, within the complete distance.

Cases: words are lower-cased (ASCII) and parted by ASCII white space; a text of fewer words is one shingle; null, empty
and blank texts are alike; a very long text is fingerprinted whole, in bounded memory; repeated rows are near copies of each
other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import written


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values of the text's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = text.lower().split()
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    return np.unique(np.array([digest(line[a:z]) for a, z in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def wide_fingerprint(values: np.ndarray, bits: int) -> np.ndarray:
    """0/1 of each bit: 1 where it is set in over half of the values' hashes. A value has a hash of 64 bits for each word."""
    factors = np.random.default_rng(7).integers(0, 1 << 63, bits // 64, np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(bits, np.int64)
    for at in range(0, len(values), 255):  # so that counts fit a byte, and memory is bounded
        h = values[at : at + 255, None] * factors
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        total += np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * total > len(values)).astype(np.uint8)


def segments(bits: int, tables: int, width: int) -> np.ndarray:
    """Which bits each table's segment has: as disjoint as their number allows."""
    rng = np.random.default_rng(11)
    order = np.concatenate([rng.permutation(bits) for _ in range(-(-tables * width // bits) + 1)])
    return order[: tables * width].reshape(tables, width)


def bit_chance(least: float) -> float:
    """The greatest chance that a bit differs between two sets of at least this similarity."""
    return math.acos(2 * least / (1 + least)) / math.pi


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' similarity is `least` or more."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            met, out = {}, []
            for a, b, one, two in zip(*(batch.column(c).cast(k).to_pylist() for c, k in (("a", pa.int64()), ("b", pa.int64()), ("one", pa.large_binary()), ("two", pa.large_binary())))):
                if a not in met:
                    met = {a: shingles(one, words)}
                if similarity(met[a], shingles(two, words)) >= least:
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    second = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("two")), "b")
    return second.join(texts.select(F.col("row").alias("a"), F.col("text").alias("one")), "a").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, *, words: int = 5, least: float = 0.8, bits: int = 2048, tables: int = 160, width: int = 24, crowd: int = 4) -> DataFrame:
    """(node, root) of the rows of docs(row long, text) that are in a group of two or more; root is the group's least row."""
    texts = docs.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    positions = segments(bits, tables, width)
    p = bit_chance(least)
    within = lambda size, deviations: int(size * p + deviations * math.sqrt(size * p * (1 - p)))

    def sketch(batches):
        import pyarrow as pa

        from . import tokens

        tokens.kept(None)
        weight = 1 << np.arange(width, dtype=np.int64)
        number = np.arange(tables, dtype=np.int64) << width
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for at, some in tokens.batches(batch.column("text")):
                sets = [shingles(t, words) for t in some]
                marks = np.stack([wide_fingerprint(s, bits) for s in sets])
                keys = np.concatenate([m[positions] @ weight + number for m in marks])
                words_of = np.packbits(marks, axis=1).view("<i8").reshape(-1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, k), pa.int32()), pa.array(v)) for v, k in ((keys, tables), (words_of, bits // 64))]
                yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + len(some)], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *lists], ["row", "n", "keys", "bits"])

    sketches = written(texts.mapInArrow(sketch, "row long, n long, keys array<bigint>, bits array<bigint>"), "sketches")
    entries = sketches.select(F.explode("keys").alias("key"), "row", F.col("bits")[0].alias("fp"))
    buckets = entries.groupBy("key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("size"), F.expr("bit_and(fp)").alias("every"), F.expr("bit_or(fp)").alias("any"))
    # Two that meet by chance differ in about half of 64 bits: for two members, what all and what any have tells.
    near64 = within(64, 3.5)
    buckets = buckets.where(f"size > 1 and (size > 2 or bit_count(every ^ any) <= {near64})")
    met = written(entries.join(written(buckets.select("key", "a", "size"), "buckets"), "key"), "bucket-members")
    known = sketches.select("row", "n", "bits")
    shared_bits = lambda x, y: sum((F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k])) for k in range(bits // 64)), F.lit(0))
    # Sets of more unlike sizes cannot be that similar; few shingles make chances coarser.
    alike = lambda x, y: (F.least(f"{x}.n", f"{y}.n") >= F.lit(least) * F.greatest(f"{x}.n", f"{y}.n")) & (shared_bits(x, y) <= within(bits, 2.5) + F.lit(0.5 * bits) / F.least(f"{x}.n", f"{y}.n"))

    def close(pairs: DataFrame) -> DataFrame:
        x, y = known.alias("x"), known.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.row")).join(y, F.col("b") == F.col("y.row")).where(alike("x", "y")).select("a", "b")

    often = met.where("row <> a").groupBy("a", "row").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("times").desc(), "a"))  # a row is in `tables` buckets
    first = written(close(often.withColumn("place", place).where("place <= 8").select("a", F.col("row").alias("b"))), "first-pairs")
    edges = written(_confirmed(first, texts, words, least), "near-pairs")
    roots = written(connected_components(edges), "near-roots")

    named = met.join(roots, met["row"] == roots["node"], "left").select("key", "row", "fp", "size", F.coalesce("root", "row").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_ = written(named.join(mixed, "key", "left_semi"), "open-members")
    differ = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root"))
    pair = [F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")]
    few = open_.where(F.col("size") <= crowd)
    near = few.alias("x").join(few.alias("y"), differ & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= near64)).select(*pair).distinct()
    rest = close(near.join(first, ["a", "b"], "left_anti"))
    many = open_.where(F.col("size") > crowd)
    if not many.isEmpty():
        many = written(many.join(sketches.select("row", "n", "bits", "keys"), "row"), "crowded")
        earlier = lambda t: F.filter(F.col(f"{t}.keys"), lambda k: k < F.col("x.key"))
        crowded = many.alias("x").join(many.alias("y"), differ & alike("x", "y") & ~F.arrays_overlap(earlier("x"), earlier("y"))).select(*pair)
        rest = rest.union(crowded.join(first, ["a", "b"], "left_anti")).distinct()
    more = written(_confirmed(written(rest, "other-pairs"), texts, words, least), "more-near-pairs")
    return roots if more.isEmpty() else written(connected_components(edges.union(more)), "near-roots")
