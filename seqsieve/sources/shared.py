"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new local one in local mode (tests, notebooks), whose tasks
    run on this machine; on a cluster an error, as executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqsieve-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_written: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, computed once however often it is read; lineage ends there, so a lost executor costs
    a re-read. The tables of a process go when it ends, or by release()."""
    path = f"{shared_dir(df.sparkSession)}/seqsieve-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that this process has written; call it once no result that reads them is needed."""
    spark = SparkSession.getActiveSession()
    while _written and spark is not None and spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
