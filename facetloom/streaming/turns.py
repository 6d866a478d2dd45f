"""Turns of a stream that may come twice, in any order, or too late."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedup_late_turns(
    turns: DataFrame, keys: tuple[str, ...] = ("session_id", "turn"), time: str = "ts", delay: str = "6 hours"
) -> DataFrame:
    """Each turn of a stream once: its first arrival.

    A turn whose time lies ``delay`` or more before the latest time of earlier
    batches is late and dropped; a repeat within ``delay`` meets its key in the
    state, one after it is late itself. So a key is held for ``delay`` only. A
    turn without a time is never late and never remembered, so it is dropped.
    """
    timed = turns.where(turns[time].isNotNull()).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys))
