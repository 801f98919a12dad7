"""An extension: daily ledger totals and index refresh as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Totals by day of event time; days close when the watermark passes them, so state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("value").alias("total")).select(F.col("window.start").cast("date").alias("day"), "runs", "total")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def refresh(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``apply`` on each batch of changed files, once for each that is new."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
