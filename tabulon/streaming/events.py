"""Structured Streaming on event tables: an extension beyond the array-language operators.

Each transformation works alike on a stream and on a batch, so a batch run checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.grouping import reduce_


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they come; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(df: DataFrame, time: str, length: str, value: str, keys: tuple[str, ...] = (), slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding event-time windows with count, sum and mean; late rows beyond the watermark go on a stream."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    d = df.withWatermark(time, late) if df.isStreaming else df
    g = d.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), reduce_(value, "sum").alias("total"), reduce_(value, "mean").alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(df: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Session windows of a key."""
    d = df.withWatermark(time, late) if df.isStreaming else df
    g = d.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(df: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """First arrival of each key."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that appends Parquet and stops when what is there has been read."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
