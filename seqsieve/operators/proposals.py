"""Signals proposed at run time: SQL expressions over a draw's reds and blue, tried on the discovery part, controlled, and staged for a person.

A proposal is known to the engine only while it is tried. What passes is staged in a table; nothing here, or anywhere in the
engine, takes a staged signal into the registry.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.functions import signals
from seqsieve.operators import governance, scans
from seqsieve.sources import logs

TESTS = ("acf_max", "perm_entropy", "mi_max")
STAGED = "name string, expression string, p_shuffle double, p_aaft double, p_marginal double, used array<string>, staged_at timestamp"


@contextmanager
def tried(proposals: dict[str, str]):
    """The registry with the proposals in it. A name that the registry has is an error."""
    if taken := sorted(n for n in proposals if n in signals.SIGNALS or n in signals.SERIES):
        raise ValueError(f"signals of these names exist: {taken}")
    signals.SIGNALS.update({name: (lambda r, b, text=text: F.expr(text)) for name, text in proposals.items()})
    try:
        yield
    finally:
        for name in proposals:
            signals.SIGNALS.pop(name, None)


def sound(draws: DataFrame, expression: str) -> bool:
    """Whether an expression is a number made of a draw's reds and blue alone, and no aggregate or window of them."""
    try:
        probe = draws.sparkSession.createDataFrame([], "reds array<int>, blue int").select(F.expr(expression).cast("double").alias("x"))
        plan = probe._jdf.queryExecution().analyzed().toString()
        return len(probe.columns) == 1 and not any(part in plan for part in ("Aggregate", "Window", "Generate", "PythonUDF", "subquery"))
    except Exception as e:
        if type(e).__name__ in ("AnalysisException", "ParseException"):
            return False
        raise


def try_out(draws: DataFrame, proposals: dict[str, str], *, used=("zero_hypothesis_cross", "random_control_label", "bh_fdr_q"), allowed=None, k: int = 40, k_control: int = 60, discovery: float = 0.7, seed: int = 0) -> DataFrame:
    """(name, expression, label, p_shuffle, p_aaft, p_marginal, artifact, gate, reason) of each proposal.

    Only the discovery part is looked at. ERROR: no sound expression. REJECTED: the feedback it was made with is not allowed, or it is not
    beyond shuffles and random phases both, or it survives on fair random draws too. STAGED: for a person to review. Proposals are a
    short list."""
    spark = draws.sparkSession
    good = {n: e for n, e in proposals.items() if sound(draws, e)}
    part = governance.discovery_part(draws.select("t", "reds", "blue"), discovery)
    rows = spark.createDataFrame(list(proposals.items()), "name string, expression string")
    found = spark.createDataFrame([], "name string, label string, p_shuffle double, p_aaft double, p_marginal double, artifact boolean")
    if good:
        axes = {n: list(TESTS) for n in good}
        with tried(good):
            labels = scans.label_axes(part, axes, k=k, seed=seed)
            control = scans.artifacts(part, axes, k=k_control, seed=seed)
        found = labels.join(control, "sig").select(F.col("sig").alias("name"), "label", "p_shuffle", "p_aaft", "p_marginal", "artifact")
    allowed = governance.FEEDBACK if allowed is None else allowed
    refused = sorted(set(used) - set(allowed))
    reason = (
        F.when(F.col("label").isNull(), "no sound expression")
        .when(F.lit(bool(refused)), f"feedback not allowed: {', '.join(refused)}")
        .when(F.col("label") != "SURVIVOR", "not beyond all null hypotheses")
        .when(F.col("artifact"), "makes its own structure on random draws")
    )
    out = rows.join(found, "name", "left").withColumn("reason", reason)
    gate = F.when(F.col("label").isNull(), "ERROR").when(F.col("reason").isNull(), "STAGED").otherwise("REJECTED")
    return out.select("name", "expression", F.coalesce("label", F.lit("ERROR")).alias("label"), "p_shuffle", "p_aaft", "p_marginal", "artifact", gate.alias("gate"), "reason")


def stage(found: DataFrame, path: str, used=("zero_hypothesis_cross", "random_control_label", "bh_fdr_q")) -> None:
    """Append what try_out() lets through to the table of signals that wait for a person."""
    rows = found.where("gate = 'STAGED'").select("name", "expression", "p_shuffle", "p_aaft", "p_marginal", F.array(*[F.lit(u) for u in used]).alias("used"), F.current_timestamp().alias("staged_at"))
    logs.append(rows, path)


def waiting(spark: SparkSession, path: str, reviews: DataFrame | None = None) -> DataFrame:
    """Staged signals, each once (its last staging), without those of reviews(name, confirmed) that a person has decided on."""
    try:
        rows = spark.read.schema(STAGED).parquet(path)
    except Exception as e:  # none staged yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], STAGED)
    last = rows.groupBy("name").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "name"]), "staged_at").alias("r")).select("name", "r.*")
    return last if reviews is None else last.join(reviews.where("confirmed is not null").select("name"), "name", "left_anti")
