"""Streams over growing logs; a Spark-native extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """The JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per key and tumbling window; rows later than the watermark are dropped from the state."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
    )


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap without rows."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
    )


def first_of_key(events: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: repeated lines of an at-least-once log are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def into_ledger(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch once to a Parquet table, a folder per batch, so that a repeated batch
    overwrites itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
