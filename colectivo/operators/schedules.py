"""Service hours and headway from session starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Schedule
from ..functions import scalar
from .ordered import with_previous
from .quantiles import exact_quantiles


def local_starts(sessions: DataFrame, cfg: Schedule = Schedule()) -> DataFrame:
    """Local start, day, bucket and second of day of completed sessions."""
    local = scalar.local_time(F.col("started_at"), cfg)
    return (
        sessions.where("status = 'completed' AND line_id IS NOT NULL")
        .select("line_id", "session_id", "started_at", local.alias("local_at"))
        .select(
            "line_id", "session_id", "started_at", "local_at",
            F.to_date("local_at").alias("local_day"),
            scalar.day_bucket(F.col("local_at")).alias("day_bucket"),
            scalar.seconds_of_day(F.col("local_at")).alias("second_of_day"),
        )
    )


def service_hours(starts: DataFrame, cfg: Schedule = Schedule()) -> DataFrame:
    """5th and 95th percentile of the start second; null below the minimum count.

    The percentile state holds at most 86 400 distinct seconds per group.
    """
    spans = starts.groupBy("line_id", "day_bucket").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.percentile("second_of_day", F.array(F.lit(0.05), F.lit(0.95))).alias("p")
    )
    enough = F.col("n_sessions") >= cfg.min_sessions
    return spans.select(
        "line_id", "day_bucket", "n_sessions",
        F.when(enough, scalar.clock_text(F.col("p")[0])).alias("service_start_at"),
        F.when(enough, scalar.clock_text(F.col("p")[1])).alias("service_end_at"),
    )


def start_gaps(starts: DataFrame, cfg: Schedule = Schedule()) -> DataFrame:
    """Minutes since the previous start of the same line and local day.

    Days are cut into hours, so a busy line does not order a whole day in one task.
    """
    stepped = with_previous(
        starts, ["line_id", "local_day"], ["started_at", "session_id"], ["started_at"], F.hour("local_at")
    )
    gap = (scalar.micros(F.col("started_at")) - scalar.micros(F.col("prev_started_at"))) / 60_000_000
    return stepped.withColumn("gap_min", gap).drop("prev_started_at")


def headways(starts: DataFrame, cfg: Schedule = Schedule()) -> DataFrame:
    """Median gap on days with enough starts, published when the gaps are steady."""
    days = starts.groupBy("line_id", "day_bucket", "local_day").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= cfg.min_sessions_per_day
    )
    gaps = (
        start_gaps(starts, cfg)
        .where((F.col("gap_min") > 0) & (F.col("gap_min") <= cfg.max_headway_min))
        .join(days, ["line_id", "day_bucket", "local_day"], "left_semi")
    )
    valid = days.groupBy("line_id", "day_bucket").agg(F.count(F.lit(1)).alias("n_valid_days"))
    steady = gaps.groupBy("line_id", "day_bucket").agg(
        F.count(F.lit(1)).alias("n_gaps"), (F.stddev_samp("gap_min") / F.avg("gap_min")).alias("cv")
    ).join(exact_quantiles(gaps, ["line_id", "day_bucket"], "gap_min", {"median_gap": 0.5}), ["line_id", "day_bucket"])
    usable = F.col("n_gaps") >= 2
    return valid.join(steady, ["line_id", "day_bucket"], "left").select(
        "line_id", "day_bucket", "n_valid_days",
        F.when(usable, F.col("cv")).alias("headway_cv"),
        F.when(usable & (F.col("cv") < cfg.max_cv), F.bround("median_gap", 0).cast("int")).alias("headway_min"),
    )


def infer_schedules(lines: DataFrame, sessions: DataFrame, cfg: Schedule = Schedule()) -> DataFrame:
    """One row per approved line and day bucket that has completed sessions."""
    approved = lines.where("status = 'approved'").select("line_id")
    starts = local_starts(sessions, cfg).join(approved, "line_id", "left_semi")
    return service_hours(starts, cfg).join(headways(starts, cfg), ["line_id", "day_bucket"], "left").select(
        "line_id", "day_bucket", "service_start_at", "service_end_at", "headway_min", "headway_cv", "n_sessions",
        F.coalesce("n_valid_days", F.lit(0)).alias("n_valid_days"),
    )


def upsert_schedules(current: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred rows replace current ones of the same line and bucket."""
    kept = current.join(inferred.select("line_id", "day_bucket"), ["line_id", "day_bucket"], "left_anti")
    return kept.unionByName(inferred, allowMissingColumns=True)


def current_headway(schedules: DataFrame, moments: DataFrame, cfg: Schedule = Schedule()) -> DataFrame:
    """Headway in force at each asked moment (line_id, at)."""
    asked = moments.withColumn("day_bucket", scalar.day_bucket(scalar.local_time(F.col("at"), cfg)))
    return asked.join(schedules.select("line_id", "day_bucket", "headway_min"), ["line_id", "day_bucket"], "left")


def schedules_by_line(lines: DataFrame, schedules: DataFrame) -> DataFrame:
    """Schedules nested per line, at most three buckets each, lines sorted by name."""
    nested = schedules.groupBy("line_id").agg(
        F.sort_array(
            F.collect_list(F.struct("day_bucket", "service_start_at", "service_end_at", "headway_min"))
        ).alias("buckets")
    )
    return nested.join(lines.select("line_id", "name"), "line_id").orderBy("name", "line_id")
