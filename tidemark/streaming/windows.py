"""Event-time windows as Structured Streaming jobs; each also runs in batch on the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that match ``path``, with the columns of ``like``; time as a zoned timestamp."""
    df = spark.readStream.schema(like.schema).option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, time: str, every: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts and sums in windows of ``every``; rows later than ``late`` behind the newest are dropped by the watermark."""
    grouped = df.withWatermark(time, late).groupBy(F.window(time, every), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, time: str, size: str, every: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    grouped = df.withWatermark(time, late).groupBy(F.window(time, size, every), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Bursts of each key with no pause of ``gap``."""
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
