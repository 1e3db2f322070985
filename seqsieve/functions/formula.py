"""Composite formulas: {op, a, b, k} over signals, nested to a depth of two, as stages of DataFrame operators.

Row-local operations are Columns; diff and lag join on t; z and thresh take one aggregate. Missing values in a formula's
result are interpolated.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.functions import signals
from seqsieve.operators import series

BINARY, UNARY, ORDERED = ("+", "-", "*", "/", "pow"), ("sin", "cos", "abs"), ("diff", "lag", "z", "thresh")
OPS = (*BINARY, *UNARY, *ORDERED)
READS = ("cont", "rev", "mean", "osc")


def combine(op: str, a: Column, b: Column) -> Column:
    """Row-local operations. Division by less than 1e-9 gives 0; pow keeps the sign and bounds the exponent by 3."""
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return F.when(F.abs(b) < 1e-9, F.lit(0.0)).otherwise(a / F.when(F.abs(b) < 1e-9, F.lit(1.0)).otherwise(b))
    if op == "pow":
        return F.signum(a) * F.pow(F.abs(a), F.abs(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), b))))
    return {"sin": F.sin, "cos": F.cos, "abs": F.abs}[op](a)


def transformed(df: DataFrame, op: str, column: str, k: int = 1) -> DataFrame:
    """df(t, ..., column) with an ordered operation applied to the column."""
    if op in ("diff", "lag"):
        out = series.shifted(df, k if op == "lag" else 1, column, "_before")
        return out.withColumn(column, F.col("_before") if op == "lag" else F.col(column) - F.col("_before")).drop("_before")
    if op == "z":
        one = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_d"))
        return series.with_scalars(df, one).withColumn(column, (F.col(column) - F.col("_m")) / (F.col("_d") + 1e-12)).drop("_m", "_d")
    one = df.agg(F.percentile(column, 0.5).alias("_m"))
    return series.with_scalars(df, one).withColumn(column, F.col(column) - F.col("_m")).drop("_m")


def build(draws: DataFrame, formula: dict, depth: int = 0) -> DataFrame:
    """(t, x) of a formula before interpolation. Operands are signal names or, above the second level, formulas; a missing
    second operand is zero."""

    def operand(spec, name: str) -> DataFrame:
        if isinstance(spec, dict):
            if depth >= 2:
                raise ValueError("formulas nest to a depth of two")
            return build(draws, spec, depth + 1).withColumnRenamed("x", name)
        return draws.select("t", signals.column(spec).alias(name))

    op = formula["op"]
    if op not in OPS:
        raise ValueError(f"unknown operation {op}")
    if op in ORDERED:
        return transformed(operand(formula["a"], "x"), op, "x", int(formula.get("k", 1)))
    if op in UNARY or formula.get("b") is None:
        return operand(formula["a"], "a").select("t", combine(op, F.col("a"), F.lit(0.0)).alias("x"))
    if isinstance(formula["a"], str) and isinstance(formula["b"], str):  # one pass over the draws
        return draws.select("t", combine(op, signals.column(formula["a"]), signals.column(formula["b"])).alias("x"))
    both = operand(formula["a"], "a").join(operand(formula["b"], "b"), "t")
    return both.select("t", combine(op, F.col("a"), F.col("b")).alias("x"))


def evaluate(draws: DataFrame, formula: dict) -> DataFrame:
    """(t, x), interpolated."""
    return series.inpaint(build(draws, formula))


def text(formula) -> str:
    """A formula in infix form."""
    if not isinstance(formula, dict):
        return str(formula)
    a, op = text(formula["a"]), formula["op"]
    if op in ("lag",):
        return f"lag({a}, {int(formula.get('k', 1))})"
    if op in UNARY or op in ORDERED:
        return f"{op}({a})"
    return f"({a} {'^' if op == 'pow' else op} {text(formula.get('b', 0))})"


def depth_of(formula) -> int:
    return 1 + max(depth_of(formula.get("a")), depth_of(formula.get("b"))) if isinstance(formula, dict) else 0


def valid(formula) -> bool:
    """Whether build() takes the formula: known operations and signals, nested to a depth of two."""
    def fits(spec, depth: int) -> bool:
        if not isinstance(spec, dict):
            return spec in signals.SIGNALS
        b = spec.get("b")
        return depth < 3 and spec.get("op") in OPS and fits(spec.get("a"), depth + 1) and (b is None or fits(b, depth + 1)) and isinstance(spec.get("k", 1), int) and 0 < spec.get("k", 1) < series.STRETCH

    return isinstance(formula, dict) and fits(formula, 0)


def key(sig: str, test: str, params: dict) -> str:
    return f"{sig}|{test}|{json.dumps(params, sort_keys=True)}"


def forecasts(df: DataFrame, k: int = 2, keys: list[str] = ()) -> DataFrame:
    """(keys, t, x) with actual (sign of the next step) and the causal sign forecasts cont, rev, mean and osc; 0 where a
    rule has nothing to go by. k is at least 2."""
    k = max(2, int(k))
    out = series.shifted_all(df.select(*keys, "t", "x"), {"after": -1, "before": 1, "old": k}, "x", keys)
    out = series.running(out, "x", "cum", keys)
    cont = F.when(F.col("t") >= 1, F.signum(F.col("x") - F.col("before"))).otherwise(0.0)
    mean = F.when(F.col("t") >= 1, F.signum((F.col("t") + 1) * F.col("x") - F.col("cum"))).otherwise(0.0)
    osc = F.when(F.col("t") >= k, F.signum(F.col("x") - F.col("old"))).otherwise(0.0)
    return out.where(F.col("after").isNotNull()).select(*keys, "t", "x", F.signum(F.col("after") - F.col("x")).alias("actual"), cont.alias("cont"), (-cont).alias("rev"), mean.alias("mean"), osc.alias("osc"))
