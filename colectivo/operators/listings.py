"""Reports over sessions, trips, lines and devices."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import micros
from ..session import snapshot
from .grid import spread_join
from .ordered import with_neighbours
from .quantiles import exact_quantiles
from .votes import tallies

#: Least rows of a slice of reports or of subscribers, their pairs that one task should make, and tasks of such a join at most.
SLICE, PAIRS_PER_TASK, MOST_TASKS = 2048, 1 << 24, 4000


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of a listing; Spark keeps only offset + limit rows per task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def recent(df: DataFrame, at: str, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def sessions_with_trips(sessions: DataFrame, lines: DataFrame, trips: DataFrame) -> DataFrame:
    """Each session with its line's name and its trip, kept when either is missing."""
    return sessions.join(lines.select("line_id", F.col("name").alias("line_name")), "line_id", "left").join(
        trips.select("session_id", "trip_id", "match_score"), "session_id", "left"
    )


def session_listing(sessions: DataFrame, trips: DataFrame, point_counts: DataFrame) -> DataFrame:
    """Sessions with point count, has-trip flag and best score."""
    best = trips.groupBy("session_id").agg(F.max("match_score").alias("match_score"), F.count(F.lit(1)).alias("n_trips"))
    return (
        sessions.join(point_counts, "session_id", "left")
        .join(best, "session_id", "left")
        .withColumns(
            {"point_count": F.coalesce("point_count", F.lit(0)), "has_trip": F.coalesce(F.col("n_trips") > 0, F.lit(False))}
        )
        .drop("n_trips")
    )


def trips_with_score(trips: DataFrame, min_score: float = 0.0) -> DataFrame:
    return trips.where(F.col("match_score") >= min_score) if min_score > 0 else trips


def active_route_per_line(routes: DataFrame) -> DataFrame:
    """Latest live version per line, least route id on ties."""
    live = routes.where("status <> 'superseded'")
    rest = [c for c in routes.columns if c != "line_id"]
    best = live.groupBy("line_id").agg(F.min_by(F.struct(*rest), F.struct(-F.col("version"), "route_id")).alias("_r"))
    return best.select("line_id", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*routes.columns)


def route_edge_listing(routes: DataFrame, edges: DataFrame, votes: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Edges of one route a line with their vote counts: the route in ``chosen`` (line_id, route_id), else its latest live version."""
    default = active_route_per_line(routes).select("line_id", "route_id")
    if chosen is not None:
        asked = chosen.join(routes.select("line_id", "route_id"), ["line_id", "route_id"], "left_semi")
        default = default.join(asked.select("line_id"), "line_id", "left_anti").unionByName(asked)
    return edges.drop("line_id", "votes_for", "votes_against").join(default, "route_id").join(tallies(votes, "route_edge_id"), "route_edge_id", "left").fillna(0, ["votes_for", "votes_against"])


def device_segments(routes: DataFrame, edges: DataFrame, overlaps: DataFrame, votes: DataFrame, trip_counts: DataFrame, min_trips: int = 3) -> tuple[DataFrame, DataFrame]:
    """What each device is shown of each line that it rides.

    ``overlaps``: device_id, route_edge_id along the device's trips; ``trip_counts``:
    device_id, line_id, trips. Returns eligibility (device_id, line_id, trips,
    eligible) and, for eligible devices, the edges of the line's live route
    that they ride and haven't voted on.
    """
    state = trip_counts.select("device_id", "line_id", "trips", (F.col("trips") >= min_trips).alias("eligible"))
    shown = route_edge_listing(routes, edges, votes)
    mine = overlaps.select("device_id", "route_edge_id").distinct().join(votes.select("device_id", "route_edge_id"), ["device_id", "route_edge_id"], "left_anti")
    return state, shown.join(mine, "route_edge_id").join(state.where("eligible").select("device_id", "line_id"), ["device_id", "line_id"], "left_semi")


def latest_version_per_variant(routes: DataFrame) -> DataFrame:
    rest = [c for c in routes.columns if c not in ("line_id", "ramal_label")]
    best = routes.groupBy("line_id", "ramal_label").agg(F.max_by(F.struct(*rest), F.struct("version", "route_id")).alias("_r"))
    return best.select("line_id", "ramal_label", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*routes.columns)


def next_version(routes: DataFrame) -> DataFrame:
    return routes.groupBy("line_id", "ramal_label").agg((F.max("version") + 1).alias("next_version"))


def route_coordinates(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Coordinates of each route in order; later edges give their first coordinate away.

    A route is bounded by its road edges, so ordering it inside a row is safe.
    """
    shaped = edges.groupBy("route_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sequence", "path"))), lambda s: s["path"]).alias("paths")
    )
    return routes.join(shaped, "route_id").withColumn("path", geo.stitch("paths", only_when_touching=False)).drop("paths")


def route_versions(routes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("route_id").agg(F.count(F.lit(1)).alias("edges"))
    return routes.join(counts, "route_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def raw_clean_pairs(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw and cleaned traces by session, with the side each came from."""
    return (
        raw.select("session_id", F.lit(True).alias("_raw"))
        .join(clean.select("session_id", "trip_id"), "session_id", "full")
        .select(
            "session_id", "trip_id",
            F.when(F.col("_raw").isNull(), "clean_only").when(F.col("trip_id").isNull(), "raw_only").otherwise("paired").alias("kind"),
        )
    )


def lines_ready(lines: DataFrame, trips: DataFrame, min_trips: int = 3) -> DataFrame:
    """Approved lines with enough clean trips to rebuild their routes."""
    return (
        trips.where("status = 'clean'")
        .join(lines.where("status = 'approved'").select("line_id"), "line_id", "left_semi")
        .groupBy("line_id").agg(F.count(F.lit(1)).alias("trips"))
        .where(F.col("trips") >= min_trips)
    )


def lines_with_raw_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("status = 'completed' AND processing_status = 'raw' AND line_id IS NOT NULL").select("line_id").distinct()


def lines_without_route(lines: DataFrame, routes: DataFrame) -> DataFrame:
    live = routes.where("status <> 'superseded'").select("line_id")
    return lines.where("status = 'approved'").join(live, "line_id", "left_anti")


def device_trip_counts(trips: DataFrame, min_trips: int = 3) -> DataFrame:
    return trips.groupBy("device_id", "line_id").agg(F.count(F.lit(1)).alias("trips")).withColumn(
        "eligible", F.col("trips") >= min_trips
    )


def eligible_devices(trips: DataFrame, min_trips: int = 3) -> DataFrame:
    return device_trip_counts(trips, min_trips).where("eligible").groupBy("line_id").agg(F.count(F.lit(1)).alias("devices"))


def fleet_dashboard(lines: DataFrame, sessions: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """One row of totals; every input is reduced to one row before they meet."""
    by_line = lines.agg(
        F.count_if(F.col("status") == "approved").alias("approved_lines"),
        F.count_if(F.col("status") == "pending").alias("pending_lines"),
    )
    done = sessions.agg(F.count_if(F.col("status") == "completed").alias("completed_sessions"))
    n_trips = trips.agg(F.count(F.lit(1)).alias("trips"))
    live = routes.where("status <> 'superseded'").agg(
        F.count(F.lit(1)).alias("active_routes"), F.count_if(F.col("fragment_count") > 1).alias("fragmented_routes")
    )
    missing = lines_without_route(lines, routes).agg(F.count(F.lit(1)).alias("lines_without_route"))
    always = F.lit(True)
    return by_line.join(done, always).join(n_trips, always).join(live, always).join(missing, always)


def line_overview(lines: DataFrame, sessions: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("line_id").agg(F.count(F.lit(1)).alias(name))
    active = active_route_per_line(routes).select(
        "line_id", F.col("version").alias("route_version"), F.col("strategy_key").alias("route_strategy"), "fragment_count"
    )
    live = count(routes.where("status <> 'superseded'"), "active_routes")
    out = lines
    for other in (count(sessions, "sessions"), count(trips, "trips"), live, active):
        out = out.join(other, "line_id", "left")
    return out.fillna(0, ["sessions", "trips", "active_routes", "fragment_count"])


def device_overview(sessions: DataFrame, trips: DataFrame, min_trips: int = 3) -> DataFrame:
    """Per device: sessions, clean trips, whether it may vote anywhere, tally per line."""
    n = sessions.groupBy("device_id").agg(F.count(F.lit(1)).alias("sessions"))
    per_line = device_trip_counts(trips.where("status = 'clean'"), min_trips)
    tally = per_line.groupBy("device_id").agg(
        F.sum("trips").alias("clean_trips"),
        F.bool_or("eligible").alias("any_eligible"),
        F.sort_array(F.collect_list(F.struct("line_id", "trips", "eligible"))).alias("per_line"),
    )
    return n.join(tally, "device_id", "left").withColumns(
        {"clean_trips": F.coalesce("clean_trips", F.lit(0)), "any_eligible": F.coalesce("any_eligible", F.lit(False))}
    )


def track_lengths(points: DataFrame, keys: Sequence[str], idx: str = "point_index") -> DataFrame:
    """Point count and haversine length per track."""
    linked = with_neighbours(points.select(*keys, idx, "lon", "lat"), keys, idx, ["lon", "lat"], before=1, after=0)
    step = geo.haversine("prev1_lon", "prev1_lat", "lon", "lat")
    return linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(step), F.lit(0.0)).alias("distance_m"))


def session_totals(sessions: DataFrame, lengths: DataFrame, trips: DataFrame) -> DataFrame:
    """Points, distance, duration and best match score per session."""
    best = trips.groupBy("session_id").agg(F.max("match_score").alias("best_score"))
    seconds = (micros(F.coalesce("ended_at", "last_activity_at")) - micros(F.col("started_at"))) / 1_000_000
    return sessions.join(lengths, "session_id", "left").join(best, "session_id", "left").select(
        "session_id", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
        seconds.alias("duration_s"), "best_score",
    )


def segment_density(points: DataFrame, keys: Sequence[str], idx: str = "point_index", min_count: int = 1) -> DataFrame:
    """Distinct traces per segment midpoint rounded to 4 decimals."""
    linked = with_neighbours(points.select(*keys, idx, "lon", "lat"), keys, idx, ["lon", "lat"], before=0, after=1)
    mid = linked.where("next1_lon IS NOT NULL").select(
        *keys,
        F.round(((F.col("lon") + F.col("next1_lon")) / 2).cast("decimal(12,8)"), 4).cast("double").alias("mid_lon"),
        F.round(((F.col("lat") + F.col("next1_lat")) / 2).cast("decimal(12,8)"), 4).cast("double").alias("mid_lat"),
    )
    return (
        mid.distinct().groupBy("mid_lon", "mid_lat").agg(F.count(F.lit(1)).alias("traces")).where(F.col("traces") >= min_count)
    )


def run_summary(lengths: DataFrame, results: DataFrame, votes: DataFrame, riders: DataFrame, found_m: float = 60.0) -> DataFrame:
    """Trace distances, variants found, turnout and vote split of a whole run.

    ``lengths``: distance_m per trace; ``results``: matched_variant,
    frechet_overlap_m; ``votes``: device_id, vote; ``riders``: device_id.
    """
    one = F.lit(1).alias("_one")
    spread = lengths.select(one, "distance_m")
    stats = spread.groupBy("_one").agg(
        F.round(F.avg("distance_m"), 1).alias("trace_distance_mean_m"),
        F.round(F.stddev_samp("distance_m"), 1).alias("trace_distance_std_m"),
    ).join(exact_quantiles(spread, ["_one"], "distance_m", {"med": 0.5}), "_one")
    found = results.where(F.col("frechet_overlap_m") <= found_m).select("matched_variant").distinct().agg(
        F.count(F.lit(1)).alias("variants_found")
    )
    best = results.agg(F.count(F.lit(1)).alias("routes"), F.min("frechet_overlap_m").alias("best_overlap_m"))
    voted = votes.select("device_id").distinct().agg(F.count(F.lit(1)).alias("voters"))
    rode = riders.select("device_id").distinct().agg(F.count(F.lit(1)).alias("riders"))
    split = votes.agg(
        F.count(F.lit(1)).alias("votes_total"),
        F.count_if(F.col("vote") == "approve").alias("votes_for"),
        F.count_if(F.col("vote") == "reject").alias("votes_against"),
    )
    always = F.lit(True)
    out = stats
    for part in (found, best, voted, rode, split):
        out = out.join(part, always)
    return out.select(
        "trace_distance_mean_m", F.round("med", 1).alias("trace_distance_median_m"), "trace_distance_std_m",
        "variants_found", "routes", "best_overlap_m",
        F.when(F.col("riders") > 0, F.round(F.col("voters") / F.col("riders"), 4)).otherwise(0.0).alias("turnout"),
        "votes_total", "votes_for", "votes_against",
    )


def quality_profile(points: DataFrame, keys: Sequence[str], idx: str = "point_index", sigmas: float = 4.0) -> DataFrame:
    """Sampling, speed and cross-track statistics per trace.

    ``points``: keys, dense idx, ts, snapped lon/lat and ``offset_m``, the
    signed distance of the raw point from the snapped line.
    """
    keys = list(keys)
    base = points.select(*keys, idx, micros(F.col("ts")).alias("us"), "lon", "lat", "offset_m")
    linked = with_neighbours(base, keys, idx, ["us", "lon", "lat"], before=1, after=0)
    steps = snapshot(linked.withColumns(
        {
            "gap_s": F.when(F.col("us") > F.col("prev1_us"), (F.col("us") - F.col("prev1_us")) / 1e6),
            "step_m": geo.haversine("prev1_lon", "prev1_lat", "lon", "lat"),
        }
    ))
    interval = exact_quantiles(steps, keys, "gap_s", {"interval_s": 0.5})
    timed = steps.join(interval, keys, "left")
    regular = F.when(F.col("gap_s") < 1.5 * F.col("interval_s"), F.col("gap_s"))
    dropped = F.greatest(F.lit(0.0), F.bround(F.col("gap_s") / F.col("interval_s"), 0) - 1)
    timing = snapshot(timed.groupBy(*keys).agg(
        F.first("interval_s").alias("interval_s"),
        F.when(F.count(regular) >= 2, F.stddev_pop(regular)).alias("jitter_s"),
        (F.sum(dropped) / (F.count("gap_s") + F.sum(dropped))).alias("missing_share"),
        (F.sum("step_m") / ((F.max("us") - F.min("us")) / 1e6)).alias("speed_m_s"),
        (F.stddev_pop("step_m") / F.avg("step_m")).alias("step_speed_cv"),
        F.regr_slope("offset_m", idx).alias("drift_per_point"),
        F.regr_intercept("offset_m", idx).alias("bias_m"),
    ))
    residual = steps.select(*keys, idx, "offset_m").join(timing.select(*keys, "drift_per_point", "bias_m"), keys).select(
        *keys, (F.col("offset_m") - F.col("bias_m") - F.col("drift_per_point") * F.col(idx)).alias("residual")
    )
    centre = snapshot(
        residual.join(exact_quantiles(residual, keys, "residual", {"centre": 0.5}), keys).withColumn(
            "far", F.abs(F.col("residual") - F.col("centre"))
        )
    )
    flagged = centre.join(exact_quantiles(centre, keys, "far", {"mad": 0.5}), keys).withColumn(
        "outlier", F.col("far") > sigmas * F.greatest(F.col("mad") * 1.4826, F.lit(1e-6))
    )
    outliers = flagged.groupBy(*keys).agg(
        F.stddev_pop(F.when(~F.col("outlier"), F.col("residual"))).alias("residual_spread_m"),
        F.avg(F.col("outlier").cast("double")).alias("outlier_share"),
        F.avg(F.when(F.col("outlier"), F.abs("residual"))).alias("outlier_size_m"),
    )
    return timing.join(outliers, keys, "left")


def device_ids(*tables: DataFrame) -> DataFrame:
    """Distinct device ids over several tables."""
    out = None
    for df in tables:
        ids = df.select("device_id").where("device_id IS NOT NULL").distinct()
        out = ids if out is None else out.union(ids)
    return out.distinct()


def slices(pairs: float) -> tuple[int, int]:
    """Tasks for so many pairs, and rows of a slice: two slices make half of a task's pairs, and at least ``SLICE`` rows are in each."""
    tasks = max(1, min(MOST_TASKS, ceil(pairs / PAIRS_PER_TASK)))
    return tasks, max(SLICE, isqrt(int(pairs / tasks / 2)))


def subscribers(lines: DataFrame, subscriptions: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices to notify about a report: subscribed to its line, reachable, not the reporter.

    ``lines``: report_id, line_id, reporter. Every report meets every subscriber
    of its line, so the work is in the pairs: they are counted first, and slices
    of a line's reports meet slices of its subscribers in so many tasks that
    none makes much more than ``PAIRS_PER_TASK``. A row is copied to each slice
    of the other side, so slices are as large as that number of tasks allows.
    """
    heard = subscriptions.select("line_id", "device_id").join(devices.where("push_token IS NOT NULL").select("device_id"), "device_id", "left_semi")
    rows = lambda df, name: df.groupBy("line_id").agg(F.count(F.lit(1)).cast("double").alias(name))
    pairs = rows(lines, "_l").join(rows(heard, "_r"), "line_id").agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    tasks, rows_per_slice = slices(pairs)
    met = spread_join(lines, heard, ["line_id"], rows_per_key=rows_per_slice, tasks=tasks)
    return met.where(F.col("reporter").isNull() | (F.col("device_id") != F.col("reporter")))
