"""Streams of events: ingestion with checkpoints, day counts, duplicates, exact rate limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.streaming.ordered import InTimeOrder, in_time_order

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; the checkpoint of the writer remembers which were read."""
    return spark.readStream.schema(EVENT.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_events(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each event once, however often the overlap re-reads it; state is bounded by the lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Closed days with their counts by type."""
    days = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type")
    return days.agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


class RateLimit(InTimeOrder):
    """At most so many calls in any so many seconds; refused calls do not count."""

    columns = ("us", "event_id")
    out = ("user_id", "event_id", "allowed")

    def __init__(self, calls: int, seconds: int):
        self.calls, self.seconds = calls, seconds

    def start(self) -> dict:
        return {"recent": []}

    def on_row(self, state: dict, row: list) -> list[tuple]:
        at, event = row
        state["recent"] = [x for x in state["recent"] if x > at - self.seconds * 1_000_000]
        allowed = len(state["recent"]) < self.calls
        if allowed:
            state["recent"].append(at)
        return [(event, allowed)]

    def over(self, state: dict, now: int) -> bool:
        return max(state["recent"], default=0) <= now - self.seconds * 1_000_000


def allowed_calls(events: DataFrame, calls: int, seconds: int, lateness: str = "2 days") -> DataFrame:
    """Whether each call of a user is within the limit of the last seconds; refused ones do not count.

    Calls are judged in order of time once the watermark has passed them, so verdicts do not hang
    on how the stream was cut into batches.
    """
    return in_time_order(events, "ts", "user_id", RateLimit(calls, seconds), "user_id long, event_id long, allowed boolean", lateness).select("event_id", "user_id", "allowed")


def ingest(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Runs all available batches through the sink; a rerun with the same checkpoint continues."""
    events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
