"""Event windows, as the same plan over a table or a stream, and ingestion by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark, which asks for a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total."""
    kept = _timed(events, late)
    return kept.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n."""
    kept = _timed(events, late)
    return kept.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_end(result: DataFrame, out: str, checkpoint: str, mode: str = "append", key: str | None = None) -> None:
    """Processes what is there, then stops; a restart goes on from the checkpoint. ``key`` drops repeated jobs within a batch."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key]) if key else batch
        # a batch that is run again overwrites its own folder
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
