"""Streams: records deduplicated as pages come in, and jobs folded from their progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_stream(events: DataFrame, keys: list[str], when: str, late: str = "1 day") -> DataFrame:
    """The first event of each key; state is dropped once a key is ``late`` behind the watermark."""
    return events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame, job: str = "job_id", status: str = "status", when: str = "ts") -> DataFrame:
    """The state of each job by its last event; use in update mode, one row for each changed job."""
    last = F.max_by(F.struct(status, when), F.struct(when, status)).alias("last")
    return events.groupBy(job).agg(last, F.count(F.lit(1)).alias("events")).select(job, "last.*", "events")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", available_now: bool = False):
    """Writes a stream's new rows; progress is persisted at most every ``every``."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
