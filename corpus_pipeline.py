"""A corpus in five stages: toxic documents go, exact copies go, near copies go, sources are mixed, tokens are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is to be written as Parquet and read back as the next
one's documents, as run() does; a stage starts by deleting the scratch tables of the stages before it. All stages but the last
return the columns of documents.

Cases, in all stages: a null text counts as empty, and empty texts are one group of copies; rows are told apart as rows, so
repeated and null ids do no harm; very long texts are taken whole; extra columns go through whatever their names, and an
empty table gives an empty result. Each stage's docstring states its ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.llm import exact_dedup, mixing, near_copies, packing, toxicity
from seqsieve.llm.scratch import discard, forget, release, scratch_path, written
from seqsieve.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay; the classifier learns as in its own query. Empty texts get the bias's score;
    equal texts are scored alike, so copies go or stay together; without labels all stay."""
    release(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels), threshold=0.5)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names for own use that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    tail = next(f"_{i}" for i in range(len(taken) + 1) if not any(f"{n}_{i}" in taken for n in names))
    return [n + tail for n in names]


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (ASCII case aside) the row with the largest doc_id stays, null being the smallest; of repeated rows
    one. Rows that go are few beside the table, and only their numbers meet the texts again."""
    release(spark)
    (row,) = _free(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "exact-rows")
    gone = written(exact_dedup.find_copies(rows, row=row).where("not kept").select(row), "exact-gone")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, by doc_id (null last), text hash and place; groups link texts of 0.8 or more of equal
    five-word shingles, through others too. Texts without words are alike."""
    release(spark)
    row, node, root, order, first = _free(docs, "row", "node", "root", "order", "first")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    groups = near_copies.groups(rows.select(F.col(row).alias("row"), "text")).select(F.col("node").alias(node), F.col("root").alias(root))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256), F.col(row).alias(row))
    members = rows.select(row, rank.alias(order)).join(groups, F.col(row) == F.col(node))
    stays = members.groupBy(root).agg(F.min(order)[row].alias(first))
    gone = members.join(stays, root).where(F.col(node) != F.col(first)).select(node)
    return rows.join(written(gone, "near-gone"), F.col(row) == F.col(node), "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; one that it takes in part keeps those words, joined by spaces.
    Documents without words are not taken; of repeated rows each counts. Which documents a source's last block cuts
    follows from the schedule; rows are not put in its order, as packing deals them anew."""
    release(spark)
    row, m_row, m_size, m_first, m_words = _free(docs, "row", "m_row", "m_size", "m_first", "m_words")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    named, pieces = mixing.takes(rows, keep=[row])
    taken = pieces.groupBy("row", "pass").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    taken = named.join(taken, "row").select(F.col(row).alias(m_row), F.col("size").alias(m_size), F.col("first").alias(m_first), F.col("words").alias(m_words))
    joined = rows.join(taken, F.col(row) == F.col(m_row))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), (F.col(m_first) + 1).cast("int"), F.col(m_words).cast("int")), " ")
    out = joined.withColumn("text", F.when(F.col(m_words) == F.col(m_size), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents of the mix, packed into sequences of at most 4096 tokens; an empty text is its end id."""
    release(spark)
    return packing.pack_documents(docs, vocabulary=vocabulary_path(), end_id=2, window=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_tokens),
]

#: The stages learn a classifier, fingerprint and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one is written; the last one's when the process ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        forget(path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs
