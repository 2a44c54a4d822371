"""Streams over the event log: last event per key, windowed counts, success streaks, freshness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """File source over a folder of event files."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type, with a watermark; the same plan runs on a batch."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def last_event(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Last event of each key by id; later files replace earlier ones (complete or update mode)."""
    return events.groupBy(key).agg(F.max(F.struct("event_id", "event_type", "value")).alias("x")).select(key, "x.event_id", "x.event_type", "x.value")


def streaks(events: DataFrame, key: str, success: str) -> DataFrame:
    """Rows since the last success per key, kept as state from batch to batch."""

    def step(k, frames, state):
        run = state.get[0] if state.exists else 0
        for pdf in frames:
            for kind in pdf.sort_values("event_id")["event_type"]:
                run = 0 if kind == success else run + 1
        state.update((run,))
        yield pd.DataFrame({key: [k[0]], "streak": [run]})

    return events.select(key, "event_id", "event_type").groupBy(key).applyInPandasWithState(step, f"{key} bigint, streak bigint", "run bigint", "update", "NoTimeout")
