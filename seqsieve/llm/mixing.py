"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the sources share `share` times all words by weight; a target stops at `most` times its source's words, and the
excess is shared again by weight until none is above. Schedule: slot i takes the point frac((i + 1/2) * golden ratio), in whole
numbers of 2^-64 and so exact at any size, mapped through the cumulative targets to a source: every stretch of the mix is
close to the target proportions. The
slots of a source are ranked, and rank r takes the r-th block of `block` words of the source's stream: its documents in
a shuffled order by hash, then again in another for the second pass. A source's last block is cut at its target, and a
source that a rounding of the schedule left short gets its missing ranks at the end, so the words taken are the target
rounded down. Ranks and places in a stream are sums in three levels (stretches of stretches, stretches, and within), so a source with
a third of all rows is never sorted in one task, and rows that share a doc_id or a null one are spread by their texts and by
number. Tables with a row for each source (targets, cumulative shares) are sorted whole: sources are taken to be few beside
rows, a million at most.

Cases: a null text has no words; a null source is a source of its own, the last in order; empty documents take nothing;
a source without words has target 0; rows with equal or null doc_id are each a document, and rows equal in id and text share
the schedule by number; a very long text spans many blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fraction in units of 2^-64, to the nearest odd number.
GOLDEN = 11_400_714_819_323_198_485


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) with ordinal, weight and target: one row for each source, so windows over all are small.

    The level L with sum(least(weight * L, most * size)) = share * total: in ascending order of cap/weight the first k
    sources stop at their caps, for the least k that leaves every other below its cap.
    """
    everything, ordered = Window.partitionBy(), Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ordinal"), F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("ordinal", F.row_number().over(ordered) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ordinal")
    out = out.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("level", (F.col("total") - F.col("caps")) / F.col("rest"))
    # A source that stays below its cap at the level of its own place fixes the level for itself and all after it.
    out = out.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "ordinal", "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return out.select("source", "source_size", "ordinal", "weight", target.alias("target"))


def _running(rows: DataFrame, key: list[str], stretch: str, order: list[str], amount: str, out: str, together: int = 1024) -> DataFrame:
    """rows with out: the sum of amount over earlier rows of the key, by stretches of stretches summed first, then stretches,
    then within. Key columns hold no nulls."""
    sums = rows.groupBy(*key, stretch).agg(F.sum(amount).alias("in_stretch")).withColumn("wide", F.floor(F.col(stretch) / together))
    wide = sums.groupBy(*key, "wide").agg(F.sum("in_stretch").alias("in_wide"))
    wide = wide.select(*key, "wide", (F.sum("in_wide").over(Window.partitionBy(*key).orderBy("wide")) - F.col("in_wide")).alias("far"))
    across = Window.partitionBy(*key, "wide").orderBy(stretch)
    sums = sums.withColumn("near", F.sum("in_stretch").over(across) - F.col("in_stretch")).join(wide, [*key, "wide"])
    sums = sums.select(*key, stretch, (F.col("far") + F.col("near")).alias("base"))
    within = Window.partitionBy(*key, stretch).orderBy(*order)
    inside = rows.withColumn("inside", F.sum(amount).over(within) - F.col(amount))
    return inside.join(sums, [*key, stretch]).withColumn(out, F.col("base") + F.col("inside")).drop("inside", "base")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows(row, key) with copy: a number from 1 among rows of equal key. Rows of the table's one part are numbered together
    (the part is in the upper bits of row), so a key with a third of all rows is split."""
    again = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(1).cast("long"))
    many = rows.join(again, key, "left_semi").withColumn("one", F.lit(1)).withColumn("part", F.shiftrightunsigned("row", 33))
    many = _running(many, [key], "part", ["row"], "one", "copy").withColumn("copy", F.col("copy") + 1).drop("one", "part")
    return rows.join(again, key, "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(many)


def takes(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 64, stretch_rows: int = 256, text: str = "text", source: str = "source", keep: list[str] = ()):
    """(rows, pieces): rows(row, doc_id, ordinal, size, source, source_size, target, copy) and what the mix takes of them,
    pieces(row, pass, first, words, slot): words of the row's text from word `first` on, in slot order. Columns named in
    `keep` go with the rows. `copy` numbers rows of equal doc_id and text, from 1."""
    spark = docs.sparkSession
    whole = F.col(text).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(whole).alias("size"), F.xxhash64(F.col("doc_id").cast("long"), whole).alias("who"), *keep)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most), "targets")
    numbered = _numbered(rows, "who")
    named = numbered.join(plan, numbered["source"].eqNullSafe(plan["source"])).select("row", "doc_id", "who", "copy", "ordinal", "size", numbered["source"], "source_size", "target", *keep)
    named = written(named, "named")

    stretches, total = max(1, named.count() // stretch_rows), plan.agg(F.sum("target")).first()[0] or 0.0
    passes = []
    for k in range(int(-(-most // 1))):
        shuffled = named.where("size > 0").withColumn("place", F.xxhash64(F.lit(k), "who", "copy")).withColumn("stretch", F.shiftrightunsigned("place", 24) % stretches)
        passes.append(_running(shuffled, ["ordinal"], "stretch", ["place", "doc_id", "size", "copy", "row"], "size", "at").withColumn("pass", F.lit(k)).withColumn("at", F.col("at") + F.col("source_size") * k))
    stream = passes[0]
    for p in passes[1:]:
        stream = stream.union(p)
    stream = stream.withColumn("limit", F.floor(F.col("target") + 1e-6)).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("limit"))).where("end > at")
    stream = stream.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    stream = stream.withColumn("from", F.greatest("at", F.col("rank") * block)).withColumn("to", F.least("end", (F.col("rank") + 1) * block))
    pieces = stream.select("ordinal", "rank", "row", "pass", (F.col("from") - F.col("at")).alias("first"), (F.col("to") - F.col("from")).alias("words"))

    slots = schedule(spark, plan, total, block)
    return named, pieces.join(slots, ["ordinal", "rank"]).select("row", "pass", "first", "words", "slot")


def schedule(spark, plan: DataFrame, total: float, block: int, chunk: int = 4096) -> DataFrame:
    """(ordinal, rank, slot): which rank of which source each slot of the mix takes."""
    n = int(-(-total // block))
    need = plan.select("ordinal", F.ceil(F.floor(F.col("target") + 1e-6) / block).alias("need"), "target").where("need > 0")
    share = need.select("ordinal", "need", (F.sum("target").over(Window.orderBy("ordinal")) / F.lit(float(total or 1))).alias("upto"), (F.col("target") / F.lit(float(total or 1))).alias("part"))
    # Sources by cells of the unit interval, four a source: a point meets only the sources that reach into its cell, and
    # at most as many rows are made as there are sources and cells.
    cells_n = max(1024, 4 * need.count())
    cells = share.withColumn("low", F.col("upto") - F.col("part")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells_n - 1e-6), F.floor(F.col("upto") * cells_n + 1e-6))))
    turns = (F.col("id").cast("decimal(18,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)") + F.lit(str(GOLDEN // 2)).cast("decimal(20,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")
    points = spark.range(n).withColumn("point", turns.cast("double") / F.lit(float(1 << 64)))
    points = points.withColumn("cell", F.floor(F.col("point") * cells_n))
    placed = points.join(cells, "cell").where("point >= low and point < upto").select(F.col("id").alias("slot"), "ordinal").withColumn("one", F.lit(1)).withColumn("stretch", F.floor(F.col("slot") / chunk))
    placed = written(placed, "placed")  # summed three ways
    ranked = _running(placed, ["ordinal"], "stretch", ["slot"], "one", "rank").select("ordinal", "rank", "slot")
    have = placed.groupBy("ordinal").agg(F.count(F.lit(1)).alias("have"))
    closing = need.join(have, "ordinal", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("need > have")
    closing = closing.select("ordinal", F.explode(F.sequence(F.col("have").cast("long"), F.col("need") - 1)).alias("rank")).withColumn("slot", F.lit(n) + F.col("rank"))
    return ranked.union(closing)


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of every row; taken counts words, repeats included, and
    first_slot is where in the mix the first of them stand (null where none is taken)."""
    named, pieces = takes(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return named.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")
