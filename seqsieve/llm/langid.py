"""Language of whole texts: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy (subwords.py).

The classifier is fitted on a bounded sample: about `per_language` documents of each language (of at most `sample_bytes`
bytes, drawn by a hash of doc_id), and about `most` of all languages, collected to the driver. Longer texts are predicted but
never learned from. A fifth of them fits the temperature of the softmax and the
score below which a prediction is rejected: the least at which the accepted ones are right with the rate `accuracy`.
Every document is predicted, over its whole text; `accepted` says whether its score reaches the rejection threshold.

Cases: a null text or one without letters is `und` with score 0 and not accepted; without any training document every
prediction is `und`; repeated rows are predicted alike; a very long text is predicted whole, in its task; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify, subwords

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
OPTIONS = {"sizes": (2, 3, 4), "buckets": 1 << 17, "dim": 8, "scale": 10.0, "steps": 200, "min_documents": 2, "rate": 0.3}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, per_language: int = 800, most: int = 16_000, sample_bytes: int = 50_000, accuracy: float = 0.99, text: str = "text", lang: str = "lang"):
    """(model, rejection threshold); a model of None where there is nothing to learn from."""
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= sample_bytes))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row for each language
    each = min(per_language, most / max(1, sizes.count()))
    rates = sizes.select("lang", (F.lit(float(each)) / F.col("n")).alias("rate"))
    found = classify.sampled(known.join(F.broadcast(rates), "lang"), F.col("rate")).select("doc_id", "text", "lang").distinct().collect()
    found = sorted((r.doc_id, r.text, r.lang) for r in found)
    if not found:
        return None, 1.0
    classes = sorted({r[2] for r in found})
    texts, labels = [r[1] for r in found], [r[2] for r in found]
    held = [i for i in range(len(texts)) if i % 5 == 4]
    model = subwords.train([t for i, t in enumerate(texts) if i % 5 != 4], [y for i, y in enumerate(labels) if i % 5 != 4], classes=classes, **OPTIONS)
    if not held:
        return model, 0.0
    scorer, truth = subwords.Scorer(model), np.array([classes.index(labels[i]) for i in held])
    means, _ = scorer.means([found[i][1].encode("utf-8", "surrogatepass") for i in held])
    loss = lambda t: -np.log(np.maximum(1e-12, replace(model, temperature=t).probabilities(means)[np.arange(len(held)), truth])).mean()
    model = replace(model, temperature=float(min(np.geomspace(0.25, 16, 49), key=loss)))
    p = model.probabilities(means)
    best, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-best, kind="stable")
    rate = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(rate >= accuracy)
    return model, float(best[order[enough[-1]]]) if len(enough) else 1.0


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, model, reject_below: float, *, text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row."""
    shared = classify.shipped(docs, model) if model is not None else None

    def run(batches):
        import pyarrow as pa

        from . import tokens

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, texts in tokens.batches(batch.column("text")):
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if shared is not None:
                    p = shared.value.probabilities(classify.scorer_for(shared).means(texts)[0])
                    best = p.argmax(1)
                    for i, t in enumerate(texts):
                        if has_letter(t):
                            names[i], scores[i] = shared.value.classes[best[i]], p[i, best[i]]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    accepted = (F.col("lang_pred") != "und") & (F.col("score") >= reject_below)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", accepted.alias("accepted"))
