"""Toxicity of whole texts: averaged subword embeddings and a linear softmax, trained jointly in numpy (subwords.py).

The classifier is fitted on a bounded sample of labelled documents (about `sample` documents of at most `sample_bytes`
bytes, drawn by a hash of doc_id), collected to the driver; every document is scored, over its whole text. Longer texts are
scored but never learned from, so words that occur only in them have no weight.

Cases: a null or empty text, or one without words, gets the score of the bias alone; a document with conflicting labels
counts as toxic; of several texts under a labelled doc_id the one with the least hash is learned from; null labels are left out; without any labelled document, or with one class only, scores are the share of
toxic ones (0 without labels); repeated rows are scored alike; a very long text is scored whole, in its task; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify, subwords

OPTIONS = {"sizes": (3, 4, 5), "buckets": 1 << 17, "dim": 8, "scale": 100.0, "steps": 900, "min_documents": 10}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, sample_bytes: int = 50_000, text: str = "text") -> subwords.Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = classify.sampled(known, sample / max(1, known.count()))  # about `sample` rows at most: safe to broadcast
    known_texts = docs.select("doc_id", F.col(text).cast("string").alias("text")).where(F.octet_length("text") <= sample_bytes)
    one = known_texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = sorted((r.doc_id, r.text, r.toxic) for r in one.select("doc_id", "t.text", "toxic").collect())  # at most one for each chosen label
    texts, toxic = [r[1] for r in rows], [int(r[2] > 0) for r in rows]
    if len(set(toxic)) < 2:  # nothing to learn: a constant score
        import numpy as np

        share = min(max(sum(toxic) / len(toxic) if toxic else 0.0, 1e-9), 1 - 1e-9)
        return subwords.Model([0, 1], np.zeros((2, 2), np.float32), np.log([1 - share, share]), OPTIONS["sizes"])
    return subwords.train(texts, toxic, classes=[0, 1], **OPTIONS)


def score(docs: DataFrame, model: subwords.Model, *, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = classify.shipped(docs, model)

    def run(batches):
        import pyarrow as pa

        from . import tokens

        scorer = classify.scorer_for(shared)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, texts in tokens.batches(batch.column("text")):
                p = shared.value.probabilities(scorer.means(texts)[0])[:, 1]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: subwords.Model, *, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score the threshold or more. No shuffle."""
    shared = classify.shipped(docs, model)

    def run(batches):
        import pyarrow as pa

        from . import tokens

        scorer = classify.scorer_for(shared)
        for batch in batches:
            for at, texts in tokens.batches(batch.column(text)):
                p = shared.value.probabilities(scorer.means(texts)[0])[:, 1]
                yield batch.slice(at, len(texts)).filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
