"""Structured Streaming: draws arriving in files, and windowed views of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.sources import draws as draw_source


def draw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Draws (issue, reds, blue) from CSV files as they land; rows that are not draws are dropped."""
    return draw_source.typed(spark.readStream.schema(draw_source.CSV_SCHEMA).csv(folder, header=True))


def ingest(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append what is available now to a Parquet table, each issue above the table's high-water mark once, then stop."""

    def land(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["issue"])
        try:
            master = spark.read.parquet(table)
        except Exception as e:  # the first batch: no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            master = None
        (fresh if master is None else draw_source.newer(master, fresh)).write.mode("append").parquet(table)

    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, kind: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value in tumbling, sliding or session windows, on a table or a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    window = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "1 day", "12 hours"), "session": F.session_window("ts", "30 minutes")}[kind]
    keys = ["user_id"] if kind == "session" else []
    out = events.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "total")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream yields from all that is available now: written, with its checkpoint, to a folder that driver and executors
    share, and read back. In complete mode each batch replaces the table, so a repeated one does no harm."""
    path, schema = f"{folder}/rows", stream.schema

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(path if mode == "complete" else f"{path}/batch=-1")
    stream.writeStream.foreachBatch(land).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path).select(*schema.names)
