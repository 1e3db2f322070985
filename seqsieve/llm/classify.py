"""Running a subword model over whole texts on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import Model, Scorer
from .tokens import kept

def scorer_for(broadcast) -> Scorer:
    """One scorer for each model and Python worker, so that tokens met are remembered over tasks."""
    model = broadcast.value  # the worker keeps the value of a broadcast, so one object for all its tasks
    return kept(("scorer", id(model)), lambda: Scorer(model))


def shipped(df: DataFrame, model: Model):
    """The model to the executors; its size is buckets * classes * 4 bytes, whatever the data."""
    return df.sparkSession.sparkContext.broadcast(model)


def sampled(rows: DataFrame, fraction, seed: int = 17) -> DataFrame:
    """Rows whose doc_id hashes below the fraction: the same rows in every run, however the table is split."""
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(place < fraction)

