"""Incremental re-measurement with Structured Streaming.

A run reads what is new (trigger availableNow, at most `files` files a batch), appends the batch's cells to a table in
the shared folder, and ends; its checkpoint makes the next run go on where this one stopped.  Cells are maxima, so that
a batch that is written twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.margins import joint_failure_record
from ..sources.storage import new_path


def event_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The table at `path` (a Parquet file or folder) as a stream."""
    schema = spark.read.parquet(path).schema
    exact = f"{path[:-1]}[{path[-1]}]"  # a pattern, which a stream needs, that nothing else fits
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(exact)


def run_cells(spark: SparkSession, path: str, state: str, files: int = 16) -> None:
    """One monitor run: adds the new events' cells (user, hour, any error) to state/cells."""

    def add(batch: DataFrame, number: int) -> None:
        cells = batch.groupBy(F.col("user_id").alias("entity"), F.hour("ts").cast("long").alias("item")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("f"))
        cells.write.mode("overwrite").parquet(f"{state}/cells/batch={number}")

    stream = event_stream(spark, path, files)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def cells(spark: SparkSession, state: str) -> DataFrame:
    """The outcome table as of the last run."""
    return spark.read.parquet(f"{state}/cells").groupBy("entity", "item").agg(F.max("f").alias("f"))


def monitor_record(spark: SparkSession, path: str) -> DataFrame:
    """The joint-failure record after a run from an empty state."""
    state = new_path(spark, "monitor")
    run_cells(spark, path, state)
    return joint_failure_record(cells(spark, state))


def windowed_errors(spark: SparkSession, path: str) -> DataFrame:
    """day, event_type, n: event-time windows of a day; later than two days an event is left out.  Each batch puts out
    the windows that it changed, and the last word on a window counts, so that open windows are in the result too."""
    state = new_path(spark, "windows")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/updates/batch={number}")

    counts = event_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.to_date(F.col("window.start")).alias("day"), "event_type", "n")
    query = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{state}/updates").groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def newest_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """user_id, ts of the latest event: a keyed maximum kept by the stream's state."""
    state = new_path(spark, "snapshots")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/updates/batch={number}")

    last = event_stream(spark, path).groupBy("user_id").agg(F.max("ts").alias("ts"))
    query = last.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{state}/updates").groupBy("user_id").agg(F.max("ts").alias("ts"))
