"""Uploads as streams: session activity, duplicate suppression, cleaning on demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_activity(points: DataFrame, silence: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Activity windows per session, closed after the silence, by event time.

    ``points``: session_id, ts. Emits a window once the watermark passes its end:
    the session was abandoned then unless it ended by itself.
    """
    window = F.session_window("ts", silence)
    return (
        points.withWatermark("ts", lateness)
        .groupBy("session_id", window)
        .agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_activity_at"))
        .select("session_id", "first_ts", "last_activity_at", "points", F.lit("abandoned").alias("status"))
    )


def drop_reuploads(points: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Keep the first copy of a point uploaded twice within the watermark (opt-in).

    The whole point is the key: two points of one moment with other coordinates both stay.
    """
    return points.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(points.columns)


def ended_batches(clean: Callable[[DataFrame], dict[str, DataFrame]], write: Callable[[dict[str, DataFrame], int], None]) -> Callable[[DataFrame, int], None]:
    """A sink for session ends that cleans the sessions ended in each micro-batch, and only them.

    ``clean`` maps a DataFrame of session ids to result tables; ``write`` stores
    them under the batch id, so a repeated batch overwrites itself.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ended = batch.where("line_id IS NOT NULL AND status = 'completed'").select("session_id").distinct()
        write(clean(ended), batch_id)

    return handle
