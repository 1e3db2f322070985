"""JSON lines, candidates, run and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines under a schema; lines that do not parse are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_candidates(spark: SparkSession, glob: str) -> DataFrame:
    """Candidates of several seed files {meta, candidates[]}; files that do not parse are skipped."""
    files = spark.read.schema("meta struct<seed:bigint,git_sha:string>, candidates array<struct<sig:string,test:string,params:string,p_raw:double,z:double,tier:string>>").json(glob, multiLine=True, mode="DROPMALFORMED")
    return files.select("meta.seed", F.explode("candidates").alias("c")).select("seed", "c.*")


def merged(candidates: DataFrame) -> DataFrame:
    """Candidates of several seeds as one list: a row for each (sig, test, params), with its least p, its z there and how many
    seeds found it."""
    best = F.min(F.struct(F.coalesce("p_raw", F.lit(1.0)).alias("p_raw"), F.abs("z").alias("far"), F.col("z").alias("z"), F.col("tier").alias("tier")))
    one = candidates.groupBy("sig", "test", "params").agg(best.alias("b"), F.countDistinct("seed").alias("seeds"))
    return one.select("sig", "test", "params", "b.p_raw", "b.z", "b.tier", "seeds")


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_numbered(rows: DataFrame, path: str, order: str, name: str = "id") -> int:
    """Append rows with ids that go on from the table's largest, in order within what is appended (a run's rows: few); the number
    of rows. One writer at a time."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max(name)).first()[0] or 0
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    numbered = rows.select((F.row_number().over(Window.orderBy(order)) + F.lit(last)).cast("long").alias(name), *rows.columns)
    numbered.write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.max(name)).first()[0] - last if numbered.head(1) else 0


def latest(evals: DataFrame, run: str = "run_id") -> DataFrame:
    """The evaluations of the last run: one aggregate, then a filter."""
    last = evals.agg(F.max(run).alias("_last"))
    return evals.join(F.broadcast(last), F.col(run) == F.col("_last")).drop("_last")


def recent(runs: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The last n rows: a top-k, not a sort of the whole table."""
    return runs.orderBy(F.col(order).desc()).limit(n)
