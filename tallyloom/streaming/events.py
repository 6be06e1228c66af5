"""Structured Streaming forms of upkeep: counters, idempotent delivery, heartbeats, rate limits, progress.

Every function takes a streaming DataFrame of events and returns one; drained() runs one over all that there is and gives what
its sink holds. Checkpoints and sinks lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, name: str = "events.parquet") -> DataFrame:
    """Stream of the files of this name in a folder, with event time as a timestamp."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives once it has taken all that there is: all batches (append), or the last one (complete)."""
    spark = stream.sparkSession
    at = shared_folder(spark, "stream")
    write = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        run = write.format("parquet").option("path", f"{at}/rows").start()
    else:
        run = write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows")).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def counters(events: DataFrame, by: str) -> DataFrame:
    """Running count and sum by kind (complete mode)."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def delivered_once(events: DataFrame, key: str, watermark: str = "30 days") -> DataFrame:
    """At-least-once delivery made exactly-once: rows of a key that was seen within the watermark are left out."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def heartbeats(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Sessions that a beat extends and that expire after so many silent seconds (complete mode)."""
    return events.groupBy(key, F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("beats"))


def rate_limited(events: DataFrame, key: str, seconds: float, limit: int) -> DataFrame:
    """event_id and denied: the first event opens a window, events beyond `limit` in it are denied, the next event after its
    end opens another. The state of a key is its window's start and count."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        denied = []
        for at in rows["ts"].astype("int64") // 1000 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("int64"):
            if start is None or at - start >= seconds * 1e6:
                start, n = at, 0
            n += 1
            denied.append(n > limit)
        state.update((int(start), int(n)))
        yield pd.DataFrame({"event_id": rows["event_id"], "denied": denied})

    return events.groupBy(key).applyInPandasWithState(step, "event_id bigint, denied boolean", "start bigint, n bigint", "append", "NoTimeout")


def running_maximum(events: DataFrame, key: str) -> DataFrame:
    """Greatest value of each key so far (complete mode): progress that never goes back."""
    return events.groupBy(key).agg(F.max("value").alias("progress"))


def newest_generation(events: DataFrame, key: str, generation) -> DataFrame:
    """Greatest generation of each key (complete mode); what is of an older one is stale."""
    return events.groupBy(key).agg(F.max(generation).alias("generation"))


def not_older(events: DataFrame, key: str, value) -> DataFrame:
    """event_id and accepted: an event whose value is below the greatest that its key has had before is refused. The state of a
    key is that value."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (best,) = state.get if state.exists else (float("-inf"),)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = rows["_value"].cummax().shift(fill_value=float("-inf")).clip(lower=best)
        state.update((float(max(best, rows["_value"].max())),))
        yield pd.DataFrame({"event_id": rows["event_id"], "accepted": rows["_value"] >= before})

    rows = events.select("event_id", "ts", key, value.cast("double").alias("_value"))
    return rows.groupBy(key).applyInPandasWithState(step, "event_id bigint, accepted boolean", "best double", "append", "NoTimeout")
