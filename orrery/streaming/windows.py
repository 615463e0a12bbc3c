"""Event-time windows over streams: tumbling, sliding and session, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with an event time."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, length: str, late: str) -> DataFrame:
    w = stream.withWatermark("at", late).groupBy(F.window("at", length), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"))


def sliding(stream: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    w = stream.withWatermark("at", late).groupBy(F.window("at", length, slide), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    w = stream.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drained(result: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet files below ``path``; windows
    that the watermark has not passed stay open and are not written."""
    run = result.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/out")
