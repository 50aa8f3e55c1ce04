"""Streams: session lines into observations, quota counters, masked audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id, mask_secrets
from ..sources.transfer import dialog, write_audit


def session_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the session files that land in a folder; each file is read once it is complete."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def observations(lines: DataFrame, kept: str = "1 hour") -> DataFrame:
    """(id, content, ...): the user's lines as observations, each content once within `kept` of its first arrival; older state is dropped,
    and what comes again after that is an exact duplicate for the write path to fold."""
    said = dialog(lines).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", kept)
    return said.select(content_id(F.col("content")).alias("id"), "content", F.lit("observation").alias("category"), F.lit(0.5).alias("confidence"), F.lit(2).alias("importance"), "arrived").dropDuplicatesWithinWatermark(["id"])


def quota_counts(requests: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests of each namespace and kind in tumbling windows; a window closes when the watermark passes it."""
    w = F.window("ts", window)
    return requests.withWatermark("ts", late).groupBy(w, "ns", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "ns", "kind", "n")


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = True):  # noqa: ANN201
    """Append a stream to Parquet; with once, all that is there now and then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="5 seconds").start()


def start_audit(events: DataFrame, path: str, checkpoint: str, params: str = "params", once: bool = True):  # noqa: ANN201
    """Append a stream of events(ts, params, ...) to the audit log, secrets masked before they are written; nothing is dropped when it is full."""

    def append(batch: DataFrame, _: int) -> None:
        write_audit(batch, path, params)

    writer = events.withColumn(params, mask_secrets(F.col(params))).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="5 seconds").start()
