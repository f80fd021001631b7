"""Streams of events, orders and images with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.sources.intake import order_of


def event_counts(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """``day, event_type, n, total``: events by window and type, late ones beyond the
    watermark dropped; the same plan serves streams and tables."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def replay(spark: SparkSession, folder: str, schema, base: str) -> DataFrame:
    """All files of a folder or glob through the stream once.

    Every micro-batch writes the counts of the windows it touched to a folder of its own
    below ``base``; the newest count of a window is its count.  Nothing is held by the
    driver, and a batch that is run again writes the same rows."""
    out = f"{base}/counts"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        event_counts(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("day", "event_type", "x.*")


def orders(messages: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Orders of a stream of HL7 messages (``arrived, message``), each control id once."""
    return messages.withWatermark("arrived", watermark).select("arrived", order_of(F.col("message")).alias("o")).select("arrived", "o.*").dropDuplicatesWithinWatermark(["control_id"])


def studies(images: DataFrame, watermark: str = "1 day") -> DataFrame:
    """``study_uid, images, last_seen`` of a stream or table of received images (``arrived``);
    a study is forgotten a watermark after its last image."""
    return (
        images.withColumn("arrived", F.col("arrived").cast("timestamp")).withWatermark("arrived", watermark)
        .groupBy("study_uid", F.session_window("arrived", watermark).alias("w")).agg(F.count(F.lit(1)).alias("images"), F.max("arrived").alias("last_seen"))
        .select("study_uid", "images", "last_seen")
    )
