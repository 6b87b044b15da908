"""Recorded tracks into session tables, and trips into reconstruction traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import collapse_edges
from ..operators.ordered import number_rows


def sessions_from_tracks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and points of track rows (track_id, point_index, ts, lon, lat, device_id?, line_id?)."""
    device = F.max("device_id") if "device_id" in rows.columns else F.lit(None).cast("string")
    line = F.max("line_id") if "line_id" in rows.columns else F.lit(None).cast("string")
    sessions = rows.groupBy("track_id").agg(
        F.min_by("ts", "point_index").alias("started_at"), F.max_by("ts", "point_index").alias("ended_at"),
        F.count(F.lit(1)).alias("points"), device.alias("_device"), line.alias("line_id"),
    )
    sessions = sessions.select(
        F.col("track_id").alias("session_id"), "line_id",
        F.coalesce(F.col("_device").cast("string"), F.concat(F.lit("simulator-"), F.col("track_id").cast("string"))).alias("device_id"),
        "started_at", "ended_at", "points", (F.col("points") >= 2).alias("has_path"), F.lit("completed").alias("status"),
        F.lit("raw").alias("processing_status"),
    )
    return sessions, rows.select(F.col("track_id").alias("session_id"), "point_index", "ts", "lon", "lat")


def accept_batch(batch: DataFrame, sessions: DataFrame, touch: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Append one upload to in-progress sessions.

    ``batch``: session_id, ts and payload. Returns accepted rows, sessions with
    last activity moved (GPS batches only, ``touch``), one acknowledgement per
    session and the rejected session ids. Arrival time is ``received_at``.
    """
    known = sessions.select("session_id", "status")
    live = known.where("status = 'in_progress'")
    accepted = batch.join(live, "session_id", "left_semi")
    acks = accepted.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("added"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("received_at").alias("_seen")
    )
    rejected = batch.select("session_id").distinct().join(known, "session_id", "left").where(
        "status IS NULL OR status <> 'in_progress'"
    ).select("session_id", F.when(F.col("status").isNull(), "unknown_session").otherwise("not_in_progress").alias("rejected_because"))
    moved = sessions.join(acks.select("session_id", "_seen"), "session_id", "left").withColumn(
        "last_activity_at", F.coalesce(F.greatest("last_activity_at", "_seen"), F.col("last_activity_at")) if touch else F.col("last_activity_at")
    ).drop("_seen")
    return accepted, moved, acks.drop("_seen"), rejected


def reconstruction_traces(trips: DataFrame, points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traces, points and collapsed edges of clean trips with at least two points.

    ``trips``: trip_id, line_id, status, quality?; ``points``: trip_id, ts, lon,
    lat; ``edges``: trip_id, seq, edge_id, forward.
    """
    clean = trips.where("status = 'clean'")
    enough = points.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    good = clean.join(enough.select("trip_id"), "trip_id", "left_semi")
    quality = F.coalesce("quality", F.lit(1.0)) if "quality" in trips.columns else F.lit(1.0)
    traces = good.select("line_id", F.col("trip_id").alias("trace_id"), quality.alias("match_quality"))
    ordered = number_rows(points.join(good.select("trip_id", "line_id"), "trip_id"), ["trip_id"], ["ts"], F.to_date("ts"), "point_index")
    own = collapse_edges(edges.join(good.select("trip_id", "line_id"), "trip_id"), ["trip_id"])
    named = lambda df: df.withColumnRenamed("trip_id", "trace_id")
    return traces, named(ordered), named(own)
