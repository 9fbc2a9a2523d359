"""Timers and change feeds on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The latest value time and count of each key in windows of a day, with events up to ``delay`` late; a streaming state."""
    held = stream.withWatermark(at, delay)
    return held.groupBy(F.window(at, "1 day").alias("day"), key).agg(F.count("*").alias("n"), F.max(at).alias("last"))


def mark_due(now: Callable[[], float], late: float, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of each batch of timers the due ones, with deliver, go to ``sink`` once for each batch id."""
    from galley.operators.history import due_timers

    def step(batch: DataFrame, batch_id: int) -> None:
        sink(due_timers(batch, now(), late), batch_id)

    return step
