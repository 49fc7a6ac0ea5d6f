"""Structured Streaming forms of the operators. Each works on batch tables too, which is how queries test them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import normalize
from quillmesh.functions import unicode as uni


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder as a stream; the schema is fixed, never inferred."""
    return spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").option("maxFilesPerTrigger", 8).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in windows of one width; later events than the watermark are left out by the stream."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def analysed(messages: DataFrame, text: str = "text") -> DataFrame:
    """The stateless part of an analysis, the same on a stream and a table."""
    c = F.col(text)
    return messages.withColumn("normalized", normalize.normalized(c)).withColumn("scripts", uni.scripts(c)).withColumn("obfuscation", uni.obfuscation(c))


def first_seen(messages: DataFrame, time: str, text: str = "text", late: str = "1 hour") -> DataFrame:
    """Messages whose normalized text was not seen within the watermark."""
    keyed = messages.withColumn("_key", F.xxhash64(normalize.normalized(F.col(text))))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
