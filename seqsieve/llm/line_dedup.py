"""Repeated passages of lines, by content-defined chunks of lines.

Lines are told by hash, and hashes by bytes: all different lines of the table meet once, and lines of one hash are compared
byte for byte; a line's verified identifier is its hash and its rank among the different lines of that hash (0 unless hashes
collide). From then on only identifiers move. A rolling hash over the identifiers of two neighbouring lines chooses chunk
boundaries, so a passage that moves down by some lines is cut as before, and a chunk of two or more lines that has an earlier
place anywhere in the table (by doc_id, then text hash, then position) is repeated. Chunk edges seldom meet the edges of a
passage, so repeated chunks are grown, and passages too short to hold a whole chunk are found, by the least chunks there are:
two neighbouring lines, or one line of `alone` words or more. Lines so covered form runs, and a run of at least
`least_words` words goes. The first place of every line stays, so no line's text is lost from the table.

Counting is aggregated before the shuffle, and the join that marks places to remove may be split by Spark, so a passage in a
third of all texts does no harm.

Cases: a null text counts as empty; rows that repeat the same doc_id and text count as one document and get equal results; a
null doc_id comes first in order; a very long text is cut whole, line by line, in its task; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

MASK = (1 << 64) - 1


def line_hashes(lines: list[bytes], bits: int = 64) -> list[int]:
    """A signed hash of each line, of so many bits."""
    import xxhash

    shift = 64 - bits
    found = (xxhash.xxh64_intdigest(line) >> shift for line in lines)
    return [h - (1 << 64) if h >> 63 else h for h in found]


def line_chunks(hashes: list[int], average: int = 2, most: int = 32) -> list[tuple[int, int]]:
    """(first line, line after) of each chunk: two lines at least, but for the last chunk, and about `average` more. A
    boundary follows a line where the rolling hash of it and the one before meets the pattern."""
    out, first, before = [], 0, 0
    for i, h in enumerate(hashes):
        rolled = (before * 0x9E3779B97F4A7C15 + h * 0xC2B2AE3D27D4EB4F) & MASK
        before = h
        if i - first >= 1 and ((rolled ^ rolled >> 29) % average == 0 or i + 1 - first >= most):
            out.append((first, i + 1))
            first = i + 1
    return out + [(first, len(hashes))] * (first < len(hashes))


def passages(lines: list[bytes], hashes: list[int], average: int, alone: int) -> list[tuple[int, int]]:
    """(first line, line after) of what is compared: chunks of two or more lines, pairs of lines that are not such a chunk,
    and long lines."""
    chunks = [(a, z) for a, z in line_chunks(hashes, average) if z - a > 1]
    pairs = set(chunks)
    out = chunks + [(i, i + 2) for i in range(len(lines) - 1) if (i, i + 2) not in pairs]
    return out + [(i, i + 1) for i, line in enumerate(lines) if len(line) >= 2 * alone - 1 and len(line.split()) >= alone]


def kept_lines(lines: list[bytes], gone: list[tuple[int, int]], least_words: int) -> tuple[list[bytes], int]:
    """The lines without the runs that repeated passages cover, where a run has enough words; and how many runs went."""
    out, at, runs = [], 0, []
    for a, z in sorted(gone):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(z, runs[-1][1])
        else:
            runs.append([a, z])
    runs = [(a, z) for a, z in runs if sum(len(x.split()) for x in lines[a:z]) >= least_words]
    for a, z in runs:
        out += lines[at:a]
        at = z
    return out + lines[at:], len(runs)


def remove_repeats(docs: DataFrame, *, average: int = 2, least_words: int = 20, alone: int = 50, hash_bits: int = 64, text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, removed_lines, removed_runs): every row's text without its repeated passages."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def lines_of(batches):
        import pyarrow as pa

        from . import tokens

        tokens.kept(None)
        for batch in batches:
            for _, texts in tokens.batches(batch.column("text")):
                own = list({line for t in texts for line in t.split(b"\n")})  # each line once for this batch
                yield pa.RecordBatch.from_arrays([pa.array(line_hashes(own, hash_bits), pa.int64()), pa.array(own, pa.binary())], ["h", "line"])

    def occurrences(batches):
        import pyarrow as pa

        from . import tokens

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text")):
                own = []
                for i, t in enumerate(texts):
                    lines, digest = t.split(b"\n"), hashlib.md5(t).digest()
                    own += [(doc_ids[at + i], digest, k, h, line) for k, (h, line) in enumerate(zip(line_hashes(lines, hash_bits), lines))]
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], ["doc_id", "digest", "i", "h", "line"])

    def places(batches):
        import pyarrow as pa

        from . import tokens

        tokens.kept(None)
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text")):
                own = []
                for i, t in enumerate(texts):
                    lines, digest = t.split(b"\n"), hashlib.md5(t).digest()
                    hashes = line_hashes(lines, hash_bits)
                    own += [(doc_ids[at + i], digest, a, hashes[a:z]) for a, z in passages(lines, hashes, average, alone)]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], ["doc_id", "digest", "first", "ids"])

    distinct = source.mapInArrow(lines_of, "h long, line binary").groupBy("h", "line").agg(F.count(F.lit(1)).alias("n"))
    collisions = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "collisions")
    found = source.mapInArrow(places, "doc_id long, digest binary, first int, ids array<bigint>")
    ranks = F.array().cast("array<bigint>")
    if not collisions.isEmpty():  # different lines with one hash: rank them, and set the ranks beside the hashes
        ranked = distinct.join(collisions, "h").select("h", "line", F.row_number().over(Window.partitionBy("h").orderBy("line")).cast("long").alias("rank"))
        told = source.mapInArrow(occurrences, "doc_id long, digest binary, i int, h long, line binary").join(ranked, ["h", "line"])
        told = told.groupBy("doc_id", "digest").agg(F.map_from_entries(F.collect_set(F.struct("i", "rank"))).alias("told"))  # a document's own lines
        met = F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("f.digest") == F.col("k.digest"))
        found = found.alias("f").join(told.alias("k"), met, "left").select("f.*", "told")
        ranks = F.transform("ids", lambda _, j: F.coalesce(F.element_at("told", F.col("first") + j), F.lit(0).cast("long")))
    # A key of 64 bits finds what is alike; the identifiers themselves are compared beside it.
    found = written(found.withColumn("ranks", ranks).select("doc_id", "digest", "first", "ids", "ranks", F.xxhash64("ids", "ranks").alias("key")), "places")
    place = F.struct("doc_id", "digest", "first")
    seen = found.groupBy("key").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other").select("key")
    shared = written(found.join(written(seen, "seen"), "key", "left_semi"), "shared-places")
    first = shared.groupBy("key", "ids", "ranks").agg(F.min(place).alias("stays"))
    gone = shared.alias("s").join(first.alias("f"), (F.col("s.key") == F.col("f.key")) & (F.col("s.ids") == F.col("f.ids")) & (F.col("s.ranks") == F.col("f.ranks")))
    gone = gone.where(~F.struct("s.doc_id", "s.digest", "s.first").eqNullSafe(F.col("stays")))
    gone = gone.groupBy("s.doc_id", "s.digest").agg(F.collect_set(F.struct("s.first", F.size("s.ids").alias("n"))).alias("gone"))  # at most a document's own

    def cut(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.large_string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for doc_id, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone"))):
                if not places:
                    out.append((doc_id, text, text.count("\n") + 1, 0, 0))
                    continue
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                kept, runs = kept_lines(lines, [(p["first"], p["first"] + p["n"]) for p in places], least_words)
                out.append((doc_id, b"\n".join(kept).decode("utf-8", "replace"), len(lines), len(lines) - len(kept), runs))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.string()), *columns[2:]], ["doc_id", "text", "n_lines", "removed_lines", "removed_runs"])

    hashed = source.withColumn("digest", F.unhex(F.md5("text"))).alias("d")
    joined = hashed.join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.digest") == F.col("g.digest")), "left")
    return joined.select("d.doc_id", "d.text", "gone").mapInArrow(cut, "doc_id long, text string, n_lines long, removed_lines long, removed_runs long")
