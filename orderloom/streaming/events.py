"""Structured Streaming twins of the event operators: an extension, as the batch ones are enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, cutoff: str | None = None, files: int = 1) -> DataFrame:
    """A file stream; what was captured at or after a cutoff is refused."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return df if cutoff is None else df.filter(F.col("ts") < F.lit(cutoff).cast("timestamp"))


def distinct_events(df: DataFrame, key: str, late: str) -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tumbling(df: DataFrame, width: str, late: str, by: list[str]) -> DataFrame:
    """Count and sum per window and key; windows close when the watermark has passed."""
    agg = df.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    agg = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), by).agg(F.count("*").alias("n"))
    return agg.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a parquet folder, and read that."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
