"""The listening log as a stream: the same rules as in batch, with state bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.listening import MOST_SECONDS
from textloom.sources.staging import work_folder


def accepted_stream(events: DataFrame, id_: str = "event_id", at: str = "ts", seconds: str = "seconds", late: str = "2 hours") -> DataFrame:
    """Idempotent ingest: ids seen within the watermark are ignored, seconds are checked and capped."""
    fine = events.filter((F.col(seconds) > 0) & ~F.isnan(seconds) & (F.col(seconds) < float("inf")))
    return fine.withColumn(seconds, F.least(F.col(seconds), F.lit(MOST_SECONDS))).withWatermark(at, late).dropDuplicatesWithinWatermark([id_])


def windowed_totals(events: DataFrame, at: str, keys: list[str], seconds: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Sums by event-time window; a window is final when the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), *keys).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now, into a Parquet table in the shared folder, and reads it back."""
    root = f"{work_folder(stream.sparkSession)}/{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def latest_drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an updating aggregate to the end: each batch adds the changed rows, the last one of a key counts."""
    root = f"{work_folder(stream.sparkSession)}/{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/_n={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{root}/rows").drop("_n")
    last = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [*keys, "_batch"]).drop("_batch")
