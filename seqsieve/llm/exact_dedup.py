"""Exact duplicates of whole texts by recipes of content-defined chunks.

Each text (ASCII letters lower-cased) is cut where a rolling hash of its last 16 bytes meets a pattern, so equal
texts are cut alike. Chunk bytes meet once: chunks of one hash are compared byte for byte, and a chunk's verified
identifier is its hash and its rank among the different chunks of that hash (0 unless hashes collide). From then on
only recipes, the ordered lists of identifiers, are compared and moved; texts are not. Counting a recipe is
aggregated before the shuffle, so a group with a third of all rows costs each task one row.

Cases: a null text counts as empty, and all empty texts are one group; the row with the largest doc_id of a group
stays; a null doc_id is the smallest; of rows that repeat the same doc_id and text exactly one stays; a very long
text is cut into chunks in its task, and only its recipe moves on; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

WINDOW = 16
#: A fixed pseudo-random word for each byte value.
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def cuts(data: bytes, average: int = 2048) -> list[int]:
    """Ends of the content-defined chunks of data: at least average/4 and at most 8*average bytes each, but for the last."""
    n, least, most = len(data), average // 4, 8 * average
    if n <= least:
        return [n] if n else []
    h, step = _BYTE[np.frombuffer(data, np.uint8)], np.uint32(0x01000193)
    for w in (1, 2, 4, 8):  # h[i] hashes bytes i .. i + 2w - 1
        h = h[:-w] * step + h[w:]
        step = np.uint32(int(step) * int(step) & 0xFFFFFFFF)
    marks = (np.flatnonzero(h >> np.uint32(32 - (average.bit_length() - 1)) == 0) + WINDOW).tolist()
    out, last = [], 0
    for m in marks:
        while m - last > most:
            last += most
            out.append(last)
        if m - last >= least:
            out.append(m)
            last = m
    while n - last > most:
        last += most
        out.append(last)
    return out + [n] * (last < n)


def _chunks(text: bytes, average: int, bits: int):
    import xxhash

    at, drop = 0, 64 - bits
    for end in cuts(text, average):
        chunk = text[at:end]
        h = xxhash.xxh64_intdigest(chunk) >> drop
        yield (h - (1 << 64) if h >> 63 else h), chunk
        at = end


def find_copies(docs: DataFrame, *, average: int = 2048, hash_bits: int = 64, text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256[, row]) for every row. row names a column of different longs, if docs
    has one that tells its rows apart."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(row).alias("row")] if row is not None else []))

    def recipe(batches):
        import pyarrow as pa

        from . import tokens

        tokens.kept(None)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text")):
                low = [t.lower() for t in texts]
                out = [pa.array(doc_ids[at : at + len(low)], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in low]), pa.array([[h for h, _ in _chunks(t, average, hash_bits)] for t in low], pa.list_(pa.int64()))]
                if row is not None:
                    out.append(batch.column("row").slice(at, len(low)))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_sha256", "recipe", *["row"] * (row is not None)])

    def chunk(batches):
        import pyarrow as pa

        from . import tokens

        tokens.kept(None)
        for batch in batches:
            for _, texts in tokens.batches(batch.column("text")):
                own = {c for t in texts for c in _chunks(t.lower(), average, hash_bits)}  # each chunk once for this batch
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), (pa.int64(), pa.binary()))], ["h", "chunk"])

    def occurrence(batches):
        import pyarrow as pa

        from . import tokens

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text")):
                own = [(doc_ids[at + k], hashlib.sha256(low).hexdigest(), i, h, c) for k, low in enumerate(t.lower() for t in texts) for i, (h, c) in enumerate(_chunks(low, average, hash_bits))]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "text_sha256", "i", "h", "chunk"])

    recipes = source.mapInArrow(recipe, "doc_id long, text_sha256 string, recipe array<bigint>" + ", row long" * (row is not None))
    recipes = written(recipes if row is not None else recipes.withColumn("row", F.monotonically_increasing_id()), "recipes")
    distinct = source.mapInArrow(chunk, "h long, chunk binary").groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    shared = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "collisions")
    key = [F.col("recipe")]
    if not shared.isEmpty():  # different chunks with one hash: rank them, and put the ranks into the recipes that hold such a hash
        ranked = distinct.join(shared, "h").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long").alias("rank"))
        ranks = source.mapInArrow(occurrence, "doc_id long, text_sha256 string, i int, h long, chunk binary").join(ranked, ["h", "chunk"])
        ranks = ranks.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("i", "rank"))).alias("ranks"))
        recipes = recipes.alias("r").join(ranks.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.text_sha256") == F.col("k.text_sha256")), "left").select("r.*", "ranks")
        recipes = written(recipes.withColumn("ranks", F.coalesce("ranks", F.array().cast("array<struct<i:int,rank:bigint>>"))), "ranked")
        key.append(F.col("ranks"))
    named = recipes.withColumn("key", F.struct(*key))
    groups = named.groupBy("key").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, "key").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", *([F.col("row").alias(row)] if row is not None else [])
    )
