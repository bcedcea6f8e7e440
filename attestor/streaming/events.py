"""Streaming forms of the time operators: windows with watermarks, sessions, merges and change alerts by key."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor.durable import fresh_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, name: str = "*.parquet") -> DataFrame:
    """A stream of the files under a folder; ts is a UTC timestamp."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and whole-cent sums per window and type; rows later than ``late`` are dropped."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def changes(events: DataFrame, least: float) -> DataFrame:
    """One alert per (user, micro-batch step) in which the user's last value moved by ``least`` or more since the one before.

    State is the last value and its time per user; late rows do not move it back.
    """

    def step(key, frames, state):
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])  # all of the key's rows of this micro-batch, in order
        if at is not None:
            rows = rows[rows["ts"] >= at]
        was = rows["value"].shift().astype(float)
        if last is not None and len(rows):
            was.iloc[0] = last
        moved = (rows["value"] - was).abs() >= least
        if len(rows):
            state.update((float(rows["value"].iloc[-1]), rows["ts"].iloc[-1]))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"][moved], "was": was[moved], "now": rows["value"][moved]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, was double, now double", "last double, at timestamp", "append", "NoTimeout")


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every micro-batch to ``merge`` (batch, number); the number lets a merge be repeated safely."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, into files, and returns them as a table."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
