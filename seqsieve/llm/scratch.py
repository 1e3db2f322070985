"""Tables written to the folder that driver and executors share, to cut lineage.

A table written once is read by every later consumer, so a lost executor costs a re-read and not a
recomputation, and a Python pass over long texts runs once however many branches use its result.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from seqsieve.sources.shared import shared_dir

_written: list[str] = []
#: Results whose readers may come at any time while the process lives.
_left: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/seqsieve-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit)
    _written.append(path)
    return path


def _at_exit() -> None:
    """What is left of a process's tables goes with it, while its session lives."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        _written.extend(_left)
        release(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to a scratch table and return a scan of that table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(path: str) -> None:
    """Leave a scratch table to its reader: release() does not delete it any more, only the end of the process or discard() does."""
    if path in _written:
        _written.remove(path)
        _left.append(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that was left to a reader who is done with it."""
    if path in _left:
        _left.remove(path)
        _deleted(spark, path)


def _deleted(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, keep: list[str] = ()) -> None:
    """Delete the scratch tables of this process but for those to keep; call it once no result that reads them is needed."""
    for name in [p for p in _written if p not in keep]:
        _written.remove(name)
        _deleted(spark, name)
