"""From raw and matched points to clean trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Cleaning
from ..functions import geo
from ..functions.scalar import micros
from ..session import snapshot
from .grid import cell, segment_cells, spread_join, with_cell
from .loops import reach_by_doubling
from .ordered import islands, number_rows, with_neighbours
from .polyline import renumber


def thin(points: DataFrame, keys: Sequence[str], idx: str = "point_index", cfg: Cleaning = Cleaning()) -> DataFrame:
    """Keep a point when it is far or late enough after the last kept one; ends stay.

    Which point follows a kept one depends only on that point: the first later
    one that is 5 m away or 30 s late. Those links are found in half-hour
    slices, and the kept points are the ones reached from the start. A point
    more than 30 s after its predecessor is always kept, so it starts a chain of
    its own and chains stay short.
    """
    keys = list(keys)
    silence_us = int(cfg.max_point_silence_s * 1_000_000)
    slice_us = 1_800_000_000
    # A copy of an earlier point (same time and place) is never kept, so copies collapse first.
    copies = points.select(*keys, F.col(idx).alias("orig"), "lon", "lat", micros(F.col("ts")).alias("us"))
    base = copies.groupBy(*keys, "us", "lon", "lat").agg(F.min("orig").alias("orig"))
    base = snapshot(number_rows(base, keys, ["us", "orig"], F.floor(F.col("us") / slice_us), "node"))
    own = F.floor(F.col("us") / slice_us)
    homes = F.when(F.col("us") % slice_us < silence_us + 1_000_000, F.array(own, own - 1)).otherwise(F.array(own))
    sliced = base.withColumn("_slice", F.explode(homes))
    ahead = Window.partitionBy(*keys, "_slice").orderBy("us").rangeBetween(0, silence_us - 1)
    here = sliced.withColumn("_ahead", F.collect_list(F.struct("node", "lon", "lat")).over(ahead)).where(F.col("_slice") == own)
    moved = F.filter(
        "_ahead",
        lambda p: (p["node"] > F.col("node")) & (geo.haversine(F.col("lon"), F.col("lat"), p["lon"], p["lat"]) >= cfg.min_point_spacing_m),
    )
    first_moved = F.array_min(F.transform(moved, lambda p: p["node"]))
    late = F.array_max(F.transform("_ahead", lambda p: p["node"])) + 1
    links = here.select(*keys, "node", F.least(first_moved, late).alias("next"))
    last = base.groupBy(*keys).agg(F.max("node").alias("last"))
    links = snapshot(links.join(last, keys).where("next <= last").select(*keys, "node", "next"))
    gaps = with_neighbours(base, keys, "node", ["us"], before=1, after=0)
    starts = gaps.where(F.col("prev1_us").isNull() | (F.col("us") - F.col("prev1_us") >= silence_us)).select(*keys, "node")
    final = points.groupBy(*keys).agg(F.max(idx).alias(idx))
    kept = base.join(reach_by_doubling(links, starts, keys), [*keys, "node"], "left_semi")
    kept = kept.select(*keys, F.col("orig").alias(idx)).union(final).distinct()
    return points.join(kept, [*keys, idx], "left_semi")


def drop_spikes(matched: DataFrame, keys: Sequence[str], idx: str = "point_index", cfg: Cleaning = Cleaning()) -> DataFrame:
    """Drop unmatched points, then lone snapped points that jump out and back.

    Each point is judged against its original neighbours; ends always stay.
    ``matched``: keys, idx, lon, lat, type, snap_m, accuracy.
    """
    valid = renumber(matched.where("type <> 'unmatched'").withColumn("_raw", F.col(idx)), keys, idx)
    n = with_neighbours(valid, keys, idx, ["lon", "lat", "snap_m"])
    ref = (F.col("prev1_lat") + F.col("lat") + F.col("next1_lat")) / 3
    px, py = geo.equirect("prev1_lon", "prev1_lat", ref)
    cx, cy = geo.equirect("lon", "lat", ref)
    nx, ny = geo.equirect("next1_lon", "next1_lat", ref)
    d_prev = geo.haversine("prev1_lon", "prev1_lat", "lon", "lat")
    d_next = geo.haversine("lon", "lat", "next1_lon", "next1_lat")
    d_skip = geo.haversine("prev1_lon", "prev1_lat", "next1_lon", "next1_lat")
    snap = F.coalesce("snap_m", F.lit(0.0))
    around = F.greatest(F.coalesce("prev1_snap_m", F.lit(0.0)), F.coalesce("next1_snap_m", F.lit(0.0)))
    spike = (
        (snap >= cfg.spike_snap_m)
        & (snap >= around + cfg.spike_snap_margin_m)
        & (geo.point_segment(cx, cy, px, py, nx, ny) >= cfg.spike_chord_m)
        & (geo.turn_cosine("prev1_lon", "prev1_lat", "lon", "lat", "next1_lon", "next1_lat") <= cfg.spike_turn_cos)
        & (d_prev + d_next > d_skip + cfg.spike_detour_m)
        & ~F.coalesce(F.col("accuracy") <= cfg.trusted_accuracy_m, F.lit(False))
    )
    inner = F.col("prev1_lon").isNotNull() & F.col("next1_lon").isNotNull()
    kept = n.where(~(inner & spike)).withColumn(idx, F.col("_raw"))
    return kept.select(*matched.columns)


def match_metrics(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score, quality and mean snap distance per trace."""
    n = F.count(F.lit(1))
    return matched.groupBy(*keys).agg(
        n.alias("points"),
        (F.count_if(F.col("type") == "matched") / n).alias("match_score"),
        (1 - F.count_if(F.col("type") == "unmatched") / n).alias("quality"),
        F.coalesce(F.avg(F.when(F.col("type") == "matched", F.coalesce("snap_m", F.lit(0.0)))), F.lit(0.0)).alias("mean_snap_m"),
    )


def quality_gate(traces: DataFrame, point_counts: DataFrame, quality: DataFrame, edge_counts: DataFrame, keys: Sequence[str], cfg: Cleaning = Cleaning()) -> DataFrame:
    """Reason to drop each trace, null when it passes.

    ``point_counts``: keys, n_points after thinning; ``quality``: keys, quality
    (1 when the matcher gave no points); ``edge_counts``: keys, n_edges.
    """
    out = traces.select(*keys).join(point_counts, list(keys), "left").join(quality, list(keys), "left").join(edge_counts, list(keys), "left")
    reason = (
        F.when(F.coalesce("n_points", F.lit(0)) < 2, "too_few_points")
        .when(F.coalesce("quality", F.lit(1.0)) < cfg.min_match_quality, "poor_match")
        .when(F.coalesce("n_edges", F.lit(0)) < cfg.min_edges, "too_few_edges")
    )
    return out.select(*keys, reason.alias("dropped_because"))


def collapse_edges(edges: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Drop an edge equal to the one before it and number the rest anew."""
    linked = with_neighbours(edges, keys, seq, ["edge_id", "forward"], before=1, after=0)
    kept = linked.where(
        ~(F.col("edge_id").eqNullSafe(F.col("prev1_edge_id")) & F.col("forward").eqNullSafe(F.col("prev1_forward")))
        | F.col("prev1_forward").isNull()
    ).drop("prev1_edge_id", "prev1_forward")
    return renumber(kept, keys, seq)


def weld_edge_shapes(edges: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One shape per trace and directed edge.

    Shapes of consecutive repeats are welded in order; of separate visits the
    shape with most vertices wins, the earlier one on ties.
    """
    runs = islands(edges, keys, seq, same=["edge_id", "forward"], name="_run")
    welded = runs.groupBy(*keys, "edge_id", "forward", "_run").agg(
        geo.stitch(F.transform(F.sort_array(F.collect_list(F.struct(seq, "path"))), lambda s: s["path"])).alias("path")
    )
    return welded.groupBy(*keys, "edge_id", "forward").agg(
        F.max_by("path", F.struct(F.size("path"), -F.col("_run"))).alias("path")
    )


def edge_shape(shape: Column, begin: Column, end: Column) -> Column:
    """Slice of a shape by begin and end index: clamped, swapped when reversed, one point doubled."""
    n = F.size(shape)
    clamp = lambda i: F.greatest(F.lit(0), F.least(i, n - 1))
    lo, hi = F.least(clamp(begin), clamp(end)), F.greatest(clamp(begin), clamp(end))
    cut = F.slice(shape, lo + 1, hi - lo + 1)
    return F.when(lo == hi, F.concat(cut, cut)).otherwise(cut)


def despike_edge_shapes(shapes: DataFrame, points: DataFrame, keys: Sequence[str], cfg: Cleaning = Cleaning()) -> DataFrame:
    """Drop shape vertices farther than 30 m from every matched point of the trace.

    ``shapes``: keys, seq, vertex, lon, lat; ``points``: keys, lon, lat. A shape
    that would keep fewer than two vertices stays as it was.
    """
    keys, size = list(keys), cfg.max_edge_detour_m
    ref = points.groupBy(*keys).agg(F.min("lat").alias("ref_lat"), F.count(F.lit(1)).alias("n"))
    flat = lambda df: df.join(ref, keys).withColumns(dict(zip(("px", "py"), geo.band("lon", "lat", "ref_lat"))))
    verts = flat(shapes)
    # Cells four times the reach: a point goes to each cell that it reaches, two on average, a vertex to its own.
    wide = 4 * size
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - size, wide), cell(F.col(c) + size, wide)))
    band = flat(points).select(*keys, "px", "py").distinct().withColumn("cx", span("px")).withColumn("cy", span("py"))
    probes = with_cell(verts.select(*keys, "seq", "vertex", F.col("px").alias("vx"), F.col("py").alias("vy")), "vx", "vy", wide)
    near = (
        spread_join(band, probes, [*keys, "cx", "cy"])
        .where(geo.dist("px", "py", "vx", "vy") <= size)
        .select(*keys, "seq", "vertex")
        .distinct()
        .withColumn("_near", F.lit(True))
    )
    out = verts.join(near, [*keys, "seq", "vertex"], "left")
    kept = out.groupBy(*keys, "seq").agg(F.count("_near").alias("_kept"))
    return (
        out.join(kept, [*keys, "seq"])
        .where((F.col("_kept") < 2) | (F.col("n") < 2) | F.col("_near"))
        .select(*shapes.columns)
    )


def refine_corners(edges: DataFrame, points: DataFrame, keys: Sequence[str], cfg: Cleaning = Cleaning()) -> DataFrame:
    """Rebuild an edge shape that cuts a corner its matched points go round.

    ``edges``: keys, seq, path; ``points``: keys, seq (the edge they snap to),
    along, lon, lat. One visit of one road edge holds few points, so both
    sides are short arrays. Shapes whose points bow at most 15 m stay.
    """
    on = [*keys, "seq"]
    gathered = points.groupBy(*on).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("along", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
        ).alias("_pts")
    )
    out = edges.join(gathered, on, "left")

    def off_shape(p):
        """Distance of one point to the shape, in the point's own band projection."""
        flat = lambda q: geo.band(q["lon"], q["lat"], p["lat"])
        px, py = flat(p)
        steps = F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1)))

        def one(i):
            a, b = F.element_at("path", i), F.element_at("path", F.least(i + 1, F.size("path")))
            return geo.point_segment(px, py, *flat(a), *flat(b))

        return F.array_min(F.transform(steps, one))

    bow = F.array_max(F.transform("_pts", off_shape))

    def follow(acc, p):
        last = F.element_at(acc, -1)
        far = geo.haversine(last["lon"], last["lat"], p["lon"], p["lat"]) > cfg.corner_min_step_m
        return F.when(far, F.concat(acc, F.array(p))).otherwise(acc)

    rebuilt = F.aggregate(
        F.concat(F.col("_pts"), F.slice("path", F.size("path"), 1)), F.slice("path", 1, 1).cast(geo.PATH_TYPE), follow
    )
    usable = (F.size("_pts") >= 2) & (F.size("path") >= 2)
    return (
        out.withColumn("_bow", F.when(usable, bow))
        .withColumn("_new", F.when(F.col("_bow") > cfg.corner_deviation_m, rebuilt))
        .withColumn("path", F.when(F.size("_new") >= 2, F.col("_new")).otherwise(F.col("path")))
        .select(*edges.columns)
    )


def explode_matches(matches: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Points and edges of nested matcher output, with positions."""
    points = matches.select(*keys, F.posexplode("matched_points").alias("point_index", "_p")).select(
        *keys, F.col("point_index").cast("bigint").alias("point_index"),
        F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"), F.col("_p.type").alias("type"),
        F.col("_p.edge_index").cast("bigint").alias("edge_index"),
        F.coalesce(F.col("_p.distance_along_edge"), F.lit(0.0)).alias("along"),
        F.col("_p.distance_from_trace_point").alias("snap_m"),
    )
    edges = matches.select(*keys, "shape_coords", F.posexplode("edges").alias("seq", "_e")).select(
        *keys, F.col("seq").cast("bigint").alias("seq"), F.col("_e.id").alias("edge_id"),
        F.coalesce(F.col("_e.forward"), F.lit(True)).alias("forward"),
        edge_shape(F.col("shape_coords"), F.col("_e.begin_shape_index"), F.col("_e.end_shape_index")).alias("path"),
        F.col("_e.names").alias("names"), F.col("_e.length").alias("length_km"),
    )
    return points, edges


def build_trips(sessions: DataFrame, matched: DataFrame, edges: DataFrame, cfg: Cleaning = Cleaning()) -> dict[str, DataFrame]:
    """Trips, trip points and trip edges of raw completed sessions.

    ``matched``: session_id, point_index, lon, lat, type, snap_m, accuracy, ts;
    ``edges``: session_id, seq, edge_id, forward. Sessions without matcher
    output fail; sessions in other states are left alone.
    """
    todo = sessions.where("status = 'completed' AND processing_status = 'raw'")
    found = matched.select("session_id").distinct()
    work = todo.select("session_id").join(found, "session_id", "left_semi")
    mine = matched.join(work, "session_id", "left_semi")
    kept = drop_spikes(mine, ["session_id"], cfg=cfg)
    points = renumber(kept, ["session_id"], "point_index")
    scores = match_metrics(mine, ["session_id"]).select("session_id", "match_score")
    snaps = match_metrics(kept, ["session_id"]).select("session_id", "mean_snap_m", F.col("points").alias("path_points"))
    trips = (
        todo.select("session_id", "line_id")
        .join(scores, "session_id")
        .join(snaps, "session_id", "left")
        .withColumns({"trip_id": F.col("session_id"), "status": F.lit("clean")})
    )
    done = sessions.join(found.withColumn("_found", F.lit(True)), "session_id", "left")
    raw = (F.col("status") == "completed") & (F.col("processing_status") == "raw")
    state = F.when(~raw, F.col("processing_status")).when(F.col("_found"), "processed").otherwise("failed")
    outcome = F.when(~raw, "skipped").when(F.col("_found"), "matched").otherwise("failed")
    return {
        "trips": trips,
        "points": points.withColumnRenamed("session_id", "trip_id"),
        "edges": collapse_edges(edges.join(work, "session_id", "left_semi"), ["session_id"]).withColumnRenamed("session_id", "trip_id"),
        "sessions": done.withColumn("processing_status", state).drop("_found"),
        "stats": done.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("sessions")),
    }


def nearest_road_edges(points: DataFrame, roads: DataFrame, keys: Sequence[str], idx: str = "point_index", cfg: Cleaning = Cleaning()) -> DataFrame:
    """Assign each point the nearest road edge within the search radius.

    This stands in for an external matcher: direction is the sign of the
    movement along the edge. ``roads``: edge_id, lon1, lat1, lon2, lat2. The
    metres are Web-Mercator shrunk by the cosine of the latitude.
    """
    keys, size = list(keys), 100.0
    x, y = geo.mercator("lon", "lat")
    moving = with_neighbours(points, keys, idx, ["lon", "lat"])
    flat = moving.withColumns({"px": x, "py": y, "shrink": F.cos(F.radians("lat"))})
    x1, y1 = geo.mercator("lon1", "lat1")
    x2, y2 = geo.mercator("lon2", "lat2")
    lines = roads.select("edge_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    reach = F.lit(cfg.search_radius_m) / F.cos(F.atan(F.sinh(F.greatest(F.abs("y1"), F.abs("y2")) / geo.MERCATOR_M)))
    cells = segment_cells(lines, size, reach * 1.01).distinct()
    pairs = spread_join(with_cell(flat, "px", "py", size), cells, ["cx", "cy"])
    gap = geo.point_segment("px", "py", "x1", "y1", "x2", "y2") * F.col("shrink")
    east = (F.coalesce("next1_lon", "lon") - F.coalesce("prev1_lon", "lon")) * F.col("shrink")
    north = F.coalesce("next1_lat", "lat") - F.coalesce("prev1_lat", "lat")
    along = east * (F.col("x2") - F.col("x1")) + north * (F.col("y2") - F.col("y1"))
    best = pairs.groupBy(*keys, idx).agg(
        F.min(F.struct(gap.alias("snap_m"), "edge_id", (along >= 0).alias("forward"))).alias("_b")
    ).where(F.col("_b.snap_m") <= cfg.search_radius_m)
    return points.join(best, [*keys, idx], "left").select(
        *points.columns, "_b.edge_id", "_b.forward", "_b.snap_m",
        F.when(F.col("_b").isNull(), "unmatched").otherwise("matched").alias("type"),
    )


def trace_edges_of(matched: DataFrame, keys: Sequence[str], idx: str = "point_index") -> DataFrame:
    """Edge sequence of matched points, consecutive repeats collapsed."""
    seen = renumber(matched.where("edge_id IS NOT NULL").select(*keys, F.col(idx).alias("seq"), "edge_id", "forward"), keys, "seq")
    return collapse_edges(seen, keys)


def despike_route(path: Column, min_turn_deg: float = 120.0, max_arm_m: float = 80.0) -> Column:
    """One left-to-right pass dropping near-reversals with a short arm.

    Routes are bounded, so a fold over one path value is safe. Callers repeat
    until nothing is dropped.
    """
    n = F.size(path)

    def step(acc, i):
        a, b, c = F.element_at(acc, -1), F.element_at(path, i), F.element_at(path, i + 1)
        turn = geo.angle_between(
            geo.bearing(a["lon"], a["lat"], b["lon"], b["lat"]), geo.bearing(b["lon"], b["lat"], c["lon"], c["lat"])
        )
        arm = F.least(
            geo.haversine(a["lon"], a["lat"], b["lon"], b["lat"]), geo.haversine(b["lon"], b["lat"], c["lon"], c["lat"])
        )
        return F.when((turn >= min_turn_deg) & (arm <= max_arm_m), acc).otherwise(F.concat(acc, F.array(b)))

    folded = F.aggregate(F.sequence(F.lit(2), n - 1), F.slice(path, 1, 1).cast(geo.PATH_TYPE), step)
    return F.when(n < 3, path).otherwise(F.concat(folded, F.slice(path, n, 1)))


def despike_routes(routes: DataFrame) -> DataFrame:
    """Repeat ``despike_route`` on every route until none changes; adds points_removed."""
    out = snapshot(routes.withColumn("_before", F.size("path")))
    while True:
        was = F.size("path")
        out = snapshot(out.withColumn("_n", was).withColumn("path", despike_route(F.col("path"))))
        if out.where(F.size("path") < F.col("_n")).isEmpty():
            return out.withColumn("points_removed", F.col("_before") - F.size("path")).drop("_before", "_n")


def trip_directions(ends: DataFrame, group: str = "line_id", min_m: float = 50.0) -> DataFrame:
    """Forward, reverse or unknown per trip by its end-to-end vector.

    ``ends``: group, trip_id, first_lon, first_lat, last_lon, last_lat. The
    canonical vector is the mean of all unit vectors turned to the majority's
    side of the first trip's vector.
    """
    mid = F.radians((F.col("first_lat") + F.col("last_lat")) / 2)
    out = ends.withColumns(
        {
            "_e": (F.col("last_lon") - F.col("first_lon")) * geo.DEG_M * F.cos(mid),
            "_n": (F.col("last_lat") - F.col("first_lat")) * geo.DEG_M,
        }
    ).withColumn("_d", F.sqrt(F.col("_e") * F.col("_e") + F.col("_n") * F.col("_n")))
    out = out.withColumns(
        {"_ue": F.when(F.col("_d") >= min_m, F.col("_e") / F.col("_d")), "_un": F.when(F.col("_d") >= min_m, F.col("_n") / F.col("_d"))}
    )
    usable = out.where("_ue IS NOT NULL")
    ref = usable.groupBy(group).agg(F.min_by(F.struct("_ue", "_un"), "trip_id").alias("_r"))
    side = F.when(F.col("_ue") * F.col("_r._ue") + F.col("_un") * F.col("_r._un") >= 0, 1.0).otherwise(-1.0)
    aligned = usable.join(ref, group).withColumn("_s", side).groupBy(group).agg(
        F.when(F.count_if(F.col("_s") > 0) < F.count_if(F.col("_s") < 0), -1.0).otherwise(1.0).alias("_flip"),
        F.avg(F.col("_ue") * F.col("_s")).alias("_me"),
        F.avg(F.col("_un") * F.col("_s")).alias("_mn"),
    ).withColumn("_norm", F.sqrt(F.col("_me") * F.col("_me") + F.col("_mn") * F.col("_mn")))
    canon = aligned.where("_norm >= 1e-9").select(
        group, (F.col("_me") * F.col("_flip") / F.col("_norm")).alias("_ce"), (F.col("_mn") * F.col("_flip") / F.col("_norm")).alias("_cn")
    )
    dot = F.round(F.col("_ue") * F.col("_ce") + F.col("_un") * F.col("_cn"), 4)
    return out.join(canon, group, "left").withColumn("dot", dot).select(
        group, "trip_id", "dot",
        F.when(F.col("dot").isNull(), "unknown").when(F.col("dot") >= -0.1, "forward").otherwise("reverse").alias("direction"),
    )


def direction_summary(directions: DataFrame, group: str = "line_id") -> DataFrame:
    counts = {d: F.count_if(F.col("direction") == d) for d in ("forward", "reverse", "unknown")}
    return directions.groupBy(group).agg(*[c.alias(d) for d, c in counts.items()]).withColumn(
        "is_mixed", (F.col("forward") > 0) & (F.col("reverse") > 0)
    )


def end_sessions(sessions: DataFrame, requests: DataFrame, lines: DataFrame, point_counts: DataFrame) -> dict[str, DataFrame]:
    """Apply end-of-recording requests.

    ``requests``: session_id, line_id?, line_name?, line_type?, is_detour,
    reason?, at. A given line completes the session, a given name opens a draft
    line, neither discards it. Requests for sessions not in progress, unknown
    lines or merged lines are rejected and leave no trace.
    """
    asked = (
        requests.withColumnRenamed("line_id", "_want")
        .join(sessions.select("session_id", "status", "device_id"), "session_id", "left")
        .join(lines.select(F.col("line_id").alias("_want"), F.col("status").alias("_line_status")), "_want", "left")
        .join(point_counts, "session_id", "left")
        .withColumn("_name", F.nullif(F.trim("line_name"), F.lit("")))
    )
    reject = (
        F.when(F.col("status").isNull(), "unknown_session")
        .when(F.col("status") != "in_progress", "not_in_progress")
        .when(F.col("_want").isNotNull() & F.col("_line_status").isNull(), "unknown_line")
        .when(F.col("_line_status") == "merged", "merged_line")
    )
    asked = asked.withColumn("rejected_because", reject)
    good = asked.where("rejected_because IS NULL").withColumns(
        {
            "new_line_id": F.when(F.col("_want").isNull() & F.col("_name").isNotNull(), F.concat(F.lit("draft-"), F.col("session_id"))),
            "new_status": F.when(F.col("_want").isNotNull() | F.col("_name").isNotNull(), "completed").otherwise("discarded"),
            "has_path": F.coalesce(F.col("point_count") >= 2, F.lit(False)),
        }
    )
    assigned = F.coalesce(F.col("_want").cast("string"), F.col("new_line_id"))
    outcome = good.select("session_id", assigned.alias("line_ref"), "new_status", "has_path", "at")
    return {
        "sessions": sessions.join(outcome, "session_id", "left").select(
            "session_id", "device_id", F.coalesce("line_ref", F.col("line_id").cast("string")).alias("line_id"),
            F.coalesce("new_status", "status").alias("status"), "has_path", F.col("at").alias("ended_at"),
        ),
        "lines": good.where("new_line_id IS NOT NULL").selectExpr(
            "new_line_id AS line_id", "_name AS name", "'draft' AS status", "line_type", "at AS created_at"
        ),
        "detours": good.where(F.col("is_detour") & F.col("has_path") & assigned.isNotNull()).select(
            "session_id", assigned.alias("line_id"), "reason", F.lit("active").alias("status"), F.col("at").alias("last_confirmed_at"),
            F.lit(1).alias("confirmed_count"), F.col("device_id").alias("reporter"),
        ),
        "rejects": asked.where("rejected_because IS NOT NULL").select("session_id", "rejected_because"),
    }
