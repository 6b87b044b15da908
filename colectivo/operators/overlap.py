"""Which route edges run along which trips: grid joins with exact distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Votes
from ..functions import geo
from .grid import cell, segment_cells, spread_join
from .ordered import with_neighbours


def trip_segments(points: DataFrame, keys: Sequence[str], idx: str = "point_index") -> DataFrame:
    """Segments of ordered points (dense ``idx`` within keys) in Web-Mercator units.

    A single-point trip gives one zero-length segment.
    """
    x, y = geo.mercator("lon", "lat")
    flat = points.select(*keys, idx, x.alias("x1"), y.alias("y1"))
    linked = with_neighbours(flat, keys, idx, ["x1", "y1"], before=0, after=1)
    return linked.where(F.col("next1_x1").isNotNull() | (F.col(idx) == 0)).select(
        *keys, F.col(idx).alias("seg"), "x1", "y1",
        F.coalesce("next1_x1", "x1").alias("x2"), F.coalesce("next1_y1", "y1").alias("y2"),
    )


def path_segments(df: DataFrame, path: str = "path", mercator: bool = True) -> DataFrame:
    """Explode an ``array<struct<lon,lat>>`` column into its segments."""
    out = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1)))))
    a, b = F.element_at(path, F.col("_i")), F.coalesce(F.try_element_at(path, F.col("_i") + 1), F.element_at(path, F.col("_i")))
    out = out.withColumns({"lon1": a["lon"], "lat1": a["lat"], "lon2": b["lon"], "lat2": b["lat"]})
    if mercator:
        out = to_mercator(out)
    return out.drop("_i", path)


def to_mercator(segments: DataFrame) -> DataFrame:
    x1, y1 = geo.mercator("lon1", "lat1")
    x2, y2 = geo.mercator("lon2", "lat2")
    return segments.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def overlapping(
    edges: DataFrame, trips: DataFrame, who: Sequence[str], within: Sequence[str] = ("line_id",), d: float = Votes().overlap_m
) -> DataFrame:
    """Distinct (who, route_edge_id) whose segments come within ``d`` Mercator units.

    ``within`` columns must agree on both sides (same line); pass () to search
    across lines. Cells are at least ``d`` wide, edges are widened by ``d``.
    """
    size = max(d, 100.0)
    edge_cells = segment_cells(edges.select(*within, "route_edge_id", "x1", "y1", "x2", "y2"), size, d).distinct()
    trip_cells = segment_cells(trips.select(*within, *[w for w in who if w not in within], "x1", "y1", "x2", "y2"), size, 0.0)
    near = geo.boxes_within("l", "r", d) & (
        geo.segment_segment("l.x1", "l.y1", "l.x2", "l.y2", "r.x1", "r.y1", "r.x2", "r.y2") <= d
    )
    pairs = spread_join(trip_cells.distinct(), edge_cells, [*within, "cx", "cy"], near)
    return pairs.select(*dict.fromkeys([*within, *who]), "route_edge_id").distinct()


def unvoted(overlaps: DataFrame, votes: DataFrame) -> DataFrame:
    return overlaps.join(votes.select("device_id", "route_edge_id"), ["device_id", "route_edge_id"], "left_anti")


def contiguous_sections(edges: DataFrame, keys: Sequence[str], name: str = "section_index") -> DataFrame:
    """Number runs of consecutive ``sequence`` per key; a key is one voter on one route,
    so its rows are bounded by the edges of the route."""
    w = Window.partitionBy(*keys).orderBy("sequence")
    run = F.col("sequence") - F.row_number().over(w)
    return edges.withColumn("_run", run).withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy("_run")) - 1).drop("_run")


def voteable_sections(overlaps: DataFrame, trip_overlaps: DataFrame, edges: DataFrame) -> DataFrame:
    """Sections a device may vote on: edge count, trips touching it, stitched shape.

    ``overlaps``: device_id, line_id, route_edge_id; ``trip_overlaps``: trip_id,
    device_id, route_edge_id; ``edges``: route_edge_id, sequence, path.
    """
    placed = overlaps.join(edges.select("route_edge_id", "sequence", "path"), "route_edge_id")
    cut = contiguous_sections(placed, ["device_id", "line_id"])
    trips = (
        trip_overlaps.join(cut.select("device_id", "route_edge_id", "line_id", "section_index"), ["device_id", "route_edge_id"])
        .select("device_id", "line_id", "section_index", "trip_id")
        .distinct()
        .groupBy("device_id", "line_id", "section_index")
        .agg(F.count(F.lit(1)).alias("trips"))
    )
    shaped = cut.groupBy("device_id", "line_id", "section_index").agg(
        F.count(F.lit(1)).alias("edges"),
        F.min("sequence").alias("first_sequence"),
        geo.stitch(
            F.transform(F.sort_array(F.collect_list(F.struct("sequence", "path"))), lambda s: s["path"])
        ).alias("geometry"),
    )
    return shaped.join(trips, ["device_id", "line_id", "section_index"], "left").withColumn(
        "trips", F.greatest(F.lit(1), F.coalesce("trips", F.lit(0)))
    )


def nearby_lines(
    edges: DataFrame, trips: DataFrame, ridden: DataFrame, line_votes: DataFrame, lines: DataFrame, d: float = Votes().nearby_m
) -> DataFrame:
    """Lines passing near a device's trips that it neither rides nor voted on, by name."""
    # Lines share road edges, so each shape is measured once and its lines are looked up after.
    shape = F.struct("x1", "y1", "x2", "y2").alias("route_edge_id")
    at = edges.select("line_id", shape).distinct()
    shapes = edges.select(shape, "x1", "y1", "x2", "y2").distinct()
    pairs = overlapping(shapes, trips, ["device_id"], (), d).join(at, "route_edge_id")
    found = pairs.select("device_id", "line_id").distinct()
    for seen in (ridden, line_votes):
        found = found.join(seen.select("device_id", "line_id").distinct(), ["device_id", "line_id"], "left_anti")
    return found.join(lines.select("line_id", "name"), "line_id").orderBy("device_id", "name", "line_id")


def lines_near_points(points: DataFrame, edges: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """(point_id, line_id, distance_m) of lines within ground metres of each point.

    ``points``: point_id, lon, lat; ``edges``: line_id, lon1, lat1, lon2, lat2.
    The distance is planar around the point, which at a few kilometres differs
    from the geodesic by well under a percent.
    """
    if not 10 <= radius_m <= 5000:
        raise ValueError("radius must lie between 10 and 5000 metres")
    size = 1000.0
    x, y = geo.mercator("lon", "lat")
    cells = points.withColumns({"px": x, "py": y}).withColumns({"cx": cell("px", size), "cy": cell("py", size)})
    shapes = to_mercator(edges.select("line_id", "lon1", "lat1", "lon2", "lat2").distinct())
    reach = F.lit(radius_m * 1.02) / F.cos(F.radians(F.greatest(F.abs("lat1"), F.abs("lat2")) + 0.1))
    shapes = segment_cells(shapes, size, reach).select("line_id", "lon1", "lat1", "lon2", "lat2", "cx", "cy").distinct()
    east = lambda lon: (F.col(lon) - F.col("lon")) * F.cos(F.radians("lat")) * geo.DEG_M
    north = lambda lat: (F.col(lat) - F.col("lat")) * geo.DEG_M
    gap = geo.point_segment(0.0, 0.0, east("lon1"), north("lat1"), east("lon2"), north("lat2"))
    near = spread_join(cells.drop("px", "py"), shapes, ["cx", "cy"]).withColumn("distance_m", gap)
    return near.where(F.col("distance_m") <= radius_m).groupBy("point_id", "line_id").agg(F.min("distance_m").alias("distance_m"))


def nearby_report(
    near: DataFrame, lines: DataFrame, routes: DataFrame, detours: DataFrame, schedules: DataFrame
) -> DataFrame:
    """Attach live variants, the latest active detour and schedules to nearby lines.

    A line has a handful of variants and three day buckets, so both lists are small.
    """
    variants = routes.where("status <> 'superseded'").groupBy("line_id").agg(
        F.sort_array(F.collect_list(F.struct("ramal_label", "route_id"))).alias("variants")
    )
    alerts = detours.where("status = 'active'").groupBy("line_id").agg(
        F.max_by("detour_id", F.struct("last_confirmed_at", "detour_id")).alias("active_detour")
    )
    hours = schedules.groupBy("line_id").agg(
        F.sort_array(F.collect_list(F.struct("day_bucket", "service_start_at", "service_end_at", "headway_min"))).alias("schedules")
    )
    return (
        near.join(lines.select("line_id", "name", "line_type"), "line_id")
        .join(variants, "line_id", "left")
        .join(alerts, "line_id", "left")
        .join(hours, "line_id", "left")
    )


def route_positions(trip_overlaps: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean edge sequence along the route per session."""
    return (
        trip_overlaps.join(edges.select("route_edge_id", "sequence"), "route_edge_id")
        .groupBy("line_id", "session_id")
        .agg(F.avg("sequence").alias("position"))
    )


def voter_blocks(sessions: DataFrame, positions: DataFrame, blocks: int) -> DataFrame:
    """Cut each line's sessions, ordered along the route, into contiguous equal blocks.

    Sessions without a position come last. Ranks are taken over distinct
    positions in slices, so a busy line is not ordered in one task.
    """
    from .ordered import number_rows

    placed = sessions.select("line_id", "session_id").join(positions, ["line_id", "session_id"], "left")
    key = F.coalesce("position", F.lit(float("inf")))
    ranked = number_rows(
        placed.withColumn("_key", key), ["line_id"], ["_key", "session_id"],
        F.when(F.col("_key") == float("inf"), F.lit(1 << 40)).otherwise(F.floor("_key")).cast("bigint"), "place",
    )
    totals = placed.groupBy("line_id").agg(F.count(F.lit(1)).alias("total"))
    n = F.greatest(F.lit(1), F.least(F.lit(blocks), F.col("total")))
    return ranked.join(totals, "line_id").select(
        "line_id", "session_id", "position", F.floor(F.col("place") * n / F.col("total")).cast("bigint").alias("block")
    )


def fit_ratio(voted: DataFrame, trip_overlaps: DataFrame, session_overlaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each key's edges that some trip or session path hugs."""
    hit = (
        trip_overlaps.select(*keys, "route_edge_id")
        .union(session_overlaps.select(*keys, "route_edge_id"))
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    return (
        voted.select(*keys, "route_edge_id").distinct()
        .join(hit, [*keys, "route_edge_id"], "left")
        .groupBy(*keys)
        .agg((F.count("hit") / F.count(F.lit(1))).alias("fit_ratio"), F.count(F.lit(1)).alias("edges"))
    )


def vote_worklist(
    active_edges: DataFrame, overlaps: DataFrame, votes: DataFrame, trip_counts: DataFrame, cfg: Votes = Votes()
) -> DataFrame:
    """Per device and line with enough trips: edges still open for its vote, edges in all."""
    total = active_edges.groupBy("line_id").agg(F.count(F.lit(1)).alias("total_edges"))
    open_edges = unvoted(overlaps, votes).groupBy("device_id", "line_id").agg(F.count(F.lit(1)).alias("pending_edges"))
    eligible = trip_counts.where(F.col("trips") >= cfg.min_trips)
    return eligible.join(total, "line_id").join(open_edges, ["device_id", "line_id"]).select(
        "device_id", "line_id", "trips", "pending_edges", "total_edges"
    )


def voter_views(votes: DataFrame, edges: DataFrame, trip_counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per device and route: voted edges, sections with majority vote, counts, bounds.

    ``votes``: device_id, route_edge_id, vote; ``edges``: route_edge_id,
    route_id, line_id, sequence, lon1, lat1, lon2, lat2; ``bounds``: device_id,
    line_id and the extremes of its trip points.
    """
    key = ["device_id", "route_id", "line_id"]
    placed = votes.select("device_id", "route_edge_id", "vote").join(edges, "route_edge_id")
    cut = contiguous_sections(placed, key)
    sections = cut.groupBy(*key, "section_index").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("vote") == "approve").alias("yes")
    ).withColumn("section_vote", F.when(F.col("yes") > F.col("edges") / 2, "approve").otherwise("reject"))
    per_section = sections.groupBy(*key).agg(
        F.count(F.lit(1)).alias("sections"), F.count_if(F.col("section_vote") == "approve").alias("approving_sections")
    )
    totals = placed.groupBy(*key).agg(
        F.count_if(F.col("vote") == "approve").alias("approve"),
        F.count_if(F.col("vote") == "reject").alias("reject"),
        F.least(F.min("lon1"), F.min("lon2")).alias("e_min_lon"),
        F.greatest(F.max("lon1"), F.max("lon2")).alias("e_max_lon"),
        F.least(F.min("lat1"), F.min("lat2")).alias("e_min_lat"),
        F.greatest(F.max("lat1"), F.max("lat2")).alias("e_max_lat"),
    )
    out = (
        totals.join(per_section, key)
        .join(trip_counts, ["device_id", "line_id"], "left")
        .join(bounds, ["device_id", "line_id"], "left")
    )
    return out.select(
        *key, "approve", "reject", "sections", "approving_sections", F.coalesce("trips", F.lit(0)).alias("trips"),
        F.least("e_min_lon", "min_lon").alias("min_lon"), F.greatest("e_max_lon", "max_lon").alias("max_lon"),
        F.least("e_min_lat", "min_lat").alias("min_lat"), F.greatest("e_max_lat", "max_lat").alias("max_lat"),
    )
