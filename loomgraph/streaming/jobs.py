"""Streams over events: latest version by key, windowed counts with watermark, work-item states, generations by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may be, and how long a claim may stay without a heartbeat.
LATENESS = "1 hour"
LEASE_MS = 600_000


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, with ts as a timestamp; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Counts and totals by event type in tumbling (or, with slide, sliding) windows; events later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str = "event_id", lateness: str = LATENESS) -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


#: Statuses of items that are over, and how long their state is kept for events that come late.
ENDED, KEPT_MS = ("succeeded", "dead_letter"), 24 * 3600 * 1000

_NEXT = {
    ("pending", "claimed"), ("retrying", "claimed"), ("claimed", "running"), ("claimed", "succeeded"), ("running", "succeeded"), ("running", "retrying"), ("claimed", "retrying"),
    ("running", "dead_letter"), ("claimed", "dead_letter"), ("dead_letter", "pending"), ("succeeded", "pending"),
}


def advance(state: tuple[str, int, int], events: pd.DataFrame) -> tuple[str, int, int]:
    """(status, attempts, rejected) after events (status, ts, event_id) in order; moves that the machine doesn't know are counted and ignored."""
    status, attempts, rejected = state
    for to in events.sort_values(["ts", "event_id"])["status"]:
        if (status, to) in _NEXT:
            attempts += to == "claimed"
            status = to
        elif status != to:
            rejected += 1
    return status, int(attempts), int(rejected)


def work_item_states(events: DataFrame) -> DataFrame:
    """(user_id, status, attempts, rejected) of each key after each micro-batch that touches it.

    events needs user_id, status, ts and event_id. The state of a key is three values; a claim or run without news for
    LEASE_MS of processing time is given back as retrying. The state of an ended item is removed after KEPT_MS without news.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, rejected = state.get if state.exists else ("pending", 0, 0)
        if state.hasTimedOut and status in ENDED:
            state.remove()  # nothing came for so long that its events are over; the row was given when it ended
            return
        if state.hasTimedOut:
            status = "retrying" if status in ("claimed", "running") else status
        else:
            got = list(frames)
            if got:
                status, attempts, rejected = advance((status, attempts, rejected), pd.concat(got))
        state.update((status, attempts, rejected))
        if status in ("claimed", "running"):
            state.setTimeoutDuration(LEASE_MS)
        elif status in ENDED:
            state.setTimeoutDuration(KEPT_MS)
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "attempts": [attempts], "rejected": [rejected]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, status string, attempts long, rejected long", "status string, attempts long, rejected long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def collect_generations(events: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is one generation, committed as a whole; batch ids make a repeated commit recognisable."""
    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
