"""Draws: reading, appending and deriving them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.operators import series
from seqsieve.sources.shared import written

CSV_SCHEMA = T.StructType([T.StructField("issue", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("r1", "r2", "r3", "r4", "r5", "r6", "b")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, issue, reds, blue): an order with six or more different parts gives a draw, in order of date and key.

    Ranks are taken within days and ranges of keys, so no task sorts all orders or a day's.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # An order's balls are bits, below zero in a second number, so that they are gathered without sorting lines.
    rest = F.col("l_partkey") % 33
    bits = [F.bit_or(F.when(there, F.expr("shiftleft(1L, cast(abs(l_partkey % 33) as int))"))).alias(name) for name, there in (("up", rest >= 0), ("down", rest < 0))]
    balls = lines.groupBy("l_orderkey").agg(*bits).where(F.coalesce(F.bit_count("up"), F.lit(0)) + F.coalesce(F.bit_count("down"), F.lit(0)) >= 6)
    down = F.expr("filter(sequence(-31, 0), v -> coalesce((shiftright(down, 1 - v) & 1L) = 1, false))")
    up = F.expr("filter(sequence(1, 33), v -> coalesce((shiftright(up, v - 1) & 1L) = 1, false))")
    balls = balls.select("l_orderkey", F.when(F.col("down").isNull(), up).otherwise(F.concat(down, up)).alias("b"))
    draws = balls.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", F.col("o_orderkey").alias("issue"), F.slice("b", 1, 6).alias("reds"), (F.col("o_custkey") % 16 + 1).cast("int").alias("blue"))
    ranked = series.dense_index(draws, F.to_date("o_orderdate"), ["o_orderdate", "issue"], within=F.struct("o_orderdate", F.floor(F.col("issue") / (1 << 22)).alias("part"))).select("t", "issue", "reds", "blue")
    return written(ranked, "draws")  # plans read it many times


def read_csv(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Draws of a CSV file with a header. Rows that are not whole numbers in range are dropped, or fail the job if strict."""
    rows = spark.read.schema(CSV_SCHEMA).csv(path, header=True, mode="FAILFAST" if strict else "PERMISSIVE")
    return typed(rows)


def typed(rows: DataFrame) -> DataFrame:
    """(issue, reds, blue) of rows of text; rows with a field that is no whole number are dropped."""
    number = {c: F.expr(f"try_cast(trim({c}) AS int)") for c in ("r1", "r2", "r3", "r4", "r5", "r6", "b")}
    out = rows.select("issue", F.array(*[number[c] for c in ("r1", "r2", "r3", "r4", "r5", "r6")]).alias("reds"), number["b"].alias("blue"))
    return out.where(F.col("issue").isNotNull() & F.col("blue").isNotNull() & F.forall("reds", lambda x: x.isNotNull()))


def flat(draws: DataFrame) -> DataFrame:
    """(issue, r1..r6, b), the layout of the CSV file."""
    return draws.select(F.col("issue").cast("string").alias("issue"), *[F.element_at("reds", i).alias(f"r{i}") for i in range(1, 7)], F.col("blue").alias("b"))


def write_csv(draws: DataFrame, path: str) -> None:
    flat(draws).sortWithinPartitions("issue").write.mode("overwrite").csv(path, header=True)


def refresh(spark: SparkSession, raw: str, clean: str) -> None:
    """A snapshot of a CSV table: rows that are no draws go, the others are written in order of issue."""
    flat(read_csv(spark, raw)).repartitionByRange("issue").sortWithinPartitions("issue").write.mode("overwrite").csv(clean, header=True)


def newer(master: DataFrame, fresh: DataFrame, key: str = "issue") -> DataFrame:
    """Rows of fresh after the largest key of master, keys compared as text; all of them if master is empty."""
    last = master.agg(F.max(F.col(key).cast("string")).alias("_last"))
    return series.with_scalars(fresh, last).where(F.col("_last").isNull() | (F.col(key).cast("string") > F.col("_last"))).drop("_last")


def append_newer(master: DataFrame, fresh: DataFrame, key: str = "issue") -> DataFrame:
    return master.unionByName(newer(master, fresh, key))


def html_rows(pages: DataFrame, html: str = "html", tag: str = "tr", cell: str = "td") -> DataFrame:
    """pages with cells array<string>: one row for each <tag> element that holds <cell> elements, inner tags stripped."""
    rows = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    out = pages.withColumn("_row", F.explode(rows))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(rf"(?is)<{cell}\b[^>]*>(.*?)</{cell}>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    return out.withColumn("cells", cells).drop("_row").where(F.size("cells") > 0)


def html_draws(pages: DataFrame, html: str = "html") -> DataFrame:
    """Draws of a results table: nine or more cells, of which the second is the issue and the next seven are the balls."""
    rows = html_rows(pages, html).where((F.size("cells") >= 9) & F.forall(F.slice("cells", 2, 8), lambda c: c.rlike(r"^\d+$")))
    number = F.transform(F.slice("cells", 3, 7), lambda c: c.cast("int"))
    return rows.select(F.element_at("cells", 2).alias("issue"), F.slice(number, 1, 6).alias("reds"), F.element_at(number, 7).alias("blue"))


def fingerprint(draws: DataFrame, tail: int = 60) -> DataFrame:
    """One row: number of draws and a digest of the last ones, at most `tail` of them."""
    n = draws.agg(F.count(F.lit(1)).alias("n"))
    last = series.with_scalars(draws, n).where(F.col("t") >= F.col("n") - tail)
    line = F.concat_ws(",", F.col("t").cast("string"), F.concat_ws(",", F.transform("reds", lambda x: x.cast("string"))), F.col("blue").cast("string"))
    text = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))), lambda s: s["line"]))
    return last.agg(F.max("n").alias("n"), F.substring(F.sha1(text), 1, 16).alias("digest"))
