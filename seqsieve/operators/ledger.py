"""An append-only audit ledger that shows when it was changed, and promotion from what it vouches for.

Entries get numbers in order and a hash of their number and fields. Each BLOCK of them, in order, has a digest of its rows' hashes, and a block's hash
covers the block before: changing, dropping, adding or moving an entry breaks its row, its block or the link after it. Rows and
digests are made and checked where they lie; only the links are followed one by one, a short row for each block. An append writes its
rows first and its blocks last: rows without a block, of an append that did not end, vouch for nothing. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.operators import scans, spectrum, statistics

BLOCK = 4096
FIELDS = ("kind", "gkey", "source", "fingerprint", "seed", "label", "passed", "verdict", "signed_by")
ROWS = "seq long, block long, kind string, gkey string, source string, fingerprint string, seed long, label string, passed boolean, verdict string, signed_by string, row_hash string"
BLOCKS = "block long, first long, n long, digest string, prev string, hash string"


def row_hash() -> Column:
    """SHA-256 of a row's number and fields, each with its length, so that no two rows read alike."""
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(F.col("seq").cast("string"), *[text(c) for c in FIELDS]), 256)


def block_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.col("prev"), *[F.col(c).cast("string") for c in ("block", "first", "n")], F.col("digest")), 256)


def digests(rows: DataFrame) -> DataFrame:
    """(block, first, n, digest) of rows(seq, block, row_hash). A block's hashes, BLOCK at most, meet in one row."""
    inside = F.array_sort(F.collect_list(F.when(F.col("seq") >= 0, F.struct("seq", "row_hash"))))
    one = rows.groupBy("block").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), inside.alias("_r"))
    return one.select("block", "first", "n", F.sha2(F.array_join(F.transform("_r", lambda r: r["row_hash"]), ""), 256).alias("digest"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) of a ledger; both empty if there is none."""
    return _table(spark, f"{path}/rows", ROWS), _table(spark, f"{path}/blocks", BLOCKS)


def append(entries: DataFrame, path: str, order: str) -> int:
    """Append entries (any of FIELDS; others are null) in the order of a column; how many blocks they make."""
    import hashlib

    spark = entries.sparkSession
    rows, blocks = read(spark, path)
    last = blocks.agg(F.max("block"), F.max_by("hash", "block")).first()
    next_block, prev = (last[0] + 1, last[1]) if last[0] is not None else (0, "")
    seq = rows.agg(F.max("seq")).first()[0]
    base = 0 if seq is None else seq + 1
    kinds = dict(part.split() for part in ROWS.split(", "))
    full = entries.select(F.col(order).alias("_o"), F.lit(0).alias("t"), *[(F.col(c) if c in entries.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in FIELDS])
    placed = spectrum.ranked(full, "_o", [], "_n").withColumns({"seq": F.col("_n") + base, "block": F.floor(F.col("_n") / BLOCK) + next_block})
    placed = placed.withColumn("row_hash", row_hash()).select(*[c.split()[0] for c in ROWS.split(", ")])
    start = f"{path}/rows"
    placed.write.mode("append").parquet(start)
    made = digests(spark.read.schema(ROWS).parquet(start).where(F.col("block") >= next_block))

    def linked(pdf):
        before, out = prev, []
        for b in pdf.sort_values("block").itertuples():
            now = hashlib.sha256(f"{before}|{b.block}|{b.first}|{b.n}|{b.digest}".encode()).hexdigest()
            out.append((b.block, b.first, b.n, b.digest, before, now))
            before = now
        import pandas as pd

        return pd.DataFrame(out, columns=["block", "first", "n", "digest", "prev", "hash"])

    # The chain goes from block to block: a row of some 200 bytes for each.
    chain = made.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(linked, BLOCKS)
    chain.coalesce(1).write.mode("append").parquet(f"{path}/blocks")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("block") >= next_block).count()


def verify(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with why: null where an entry is as it was written, else the first of content (its fields have another hash), unsealed (no
    block), block (rows of its block are changed, missing, doubled or new), link (the block is not the one that follows)."""
    now = digests(rows).select("block", *[F.col(c).alias(f"_{c}") for c in ("first", "n", "digest")])
    before = blocks.select((F.col("block") + 1).alias("block"), F.col("hash").alias("_before"))
    told = blocks.join(now, "block", "left").join(before, "block", "left")
    same = (F.col("first") == F.col("_first")) & (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest"))
    linked = (F.col("hash") == block_hash()) & (F.col("prev") == F.when(F.col("block") == 0, "").otherwise(F.coalesce("_before", F.lit("-"))))
    told = told.groupBy("block").agg(F.min(F.coalesce(same, F.lit(False))).alias("_same"), F.min(F.coalesce(linked, F.lit(False))).alias("_linked"), F.count(F.lit(1)).alias("_sealed"))
    why = F.when(F.col("row_hash") != row_hash(), "content").when(F.col("_sealed").isNull(), "unsealed").when(~F.col("_same") | (F.col("_sealed") > 1), "block").when(~F.col("_linked"), "link")
    return rows.join(told, "block", "left").withColumn("why", why).drop("_same", "_linked", "_sealed")


def admitted(draws: DataFrame, candidates: DataFrame, *, k: int = 60, seed: int = 0) -> DataFrame:
    """candidates(gkey, sig, test, ...) with label and passed: whether their signal survives on fair random draws, as many as these,
    under their own test, too; then they are refused. To be appended to the ledger, whatever came out."""
    spark, control = draws.sparkSession, None
    asked = sorted({(r.sig, r.test) for r in candidates.select("sig", "test").distinct().collect() if r.test in statistics.TESTS})  # a submission's
    for test in sorted({t for _, t in asked}):
        one = scans.artifacts(draws, {s: [test] for s, t in asked if t == test}, tests=(test,), k=k, seed=seed).withColumn("test", F.lit(test))
        control = one if control is None else control.unionByName(one)
    if control is None:
        control = spark.createDataFrame([], "sig string, artifact boolean, test string")
    out = candidates.join(F.broadcast(control), ["sig", "test"], "left")
    return out.withColumn("label", F.when(F.col("artifact"), "SURVIVOR").when(~F.col("artifact"), "NOT_SURVIVOR").otherwise("ERROR")).withColumn("passed", F.coalesce(~F.col("artifact"), F.lit(False))).drop("artifact")


def promotable(rows: DataFrame, blocks: DataFrame, signatures: DataFrame) -> DataFrame:
    """(gkey, signed_by) of the candidates that may be promoted: the ledger vouches for a candidate entry that passed the control and
    for a verdict SIGNAL, its latest, and a person has signed. Nothing is promoted by the engine itself."""
    good = verify(rows, blocks).where("why is null")
    passed = good.where("kind = 'candidate' and passed").select("gkey").distinct()
    verdicts = good.where("kind = 'verdict'").groupBy("gkey").agg(F.max_by("verdict", "seq").alias("v")).where("v = 'SIGNAL'").select("gkey")
    signed = signatures.where("signed_by is not null").groupBy("gkey").agg(F.min("signed_by").alias("signed_by"))
    return passed.join(verdicts, "gkey").join(signed, "gkey").select("gkey", "signed_by")
