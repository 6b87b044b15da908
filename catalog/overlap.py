from pyspark.sql import functions as F

from catalog import query
from colectivo.operators import listings, overlap as ops
from colectivo.session import snapshot
from fixtures import Tables, point_seg, seg_seg, with_tables


def segments(t: Tables):
    return ops.trip_segments(t.trace_points.selectExpr("trace_id AS device_id", "trace_id AS session_id", "line_id", "point_index", "lon", "lat"),
                             ["device_id", "session_id", "line_id"])


def edges(t: Tables):
    return ops.to_mercator(t.route_edges)


def device_trips(t: Tables):
    return t.trips.where("status = 'clean'").groupBy("device_id", "line_id").agg(F.count(F.lit(1)).alias("trips"))


def pairs(d: float) -> str:
    return f"""pairs AS (SELECT DISTINCT s.trace_id AS device_id, e.line_id, e.route_edge_id, e.sequence FROM trip_segments s
      JOIN edge_segments e ON s.line_id = e.line_id WHERE {seg_seg('s', 'e')} <= {d})"""


NEED = ("trip_segments", "edge_segments", "route_votes")


@query("j05_edges_along_trips", with_tables(f"WITH {pairs(50.0)} SELECT device_id, line_id, route_edge_id FROM pairs", *NEED))
def edges_along_trips(t: Tables):
    return ops.overlapping(edges(t), segments(t), ["device_id"])


@query("j06_unvoted_edges", with_tables(f"""WITH {pairs(50.0)} SELECT device_id, line_id, route_edge_id FROM pairs p
    WHERE NOT EXISTS (SELECT 1 FROM route_votes v WHERE v.device_id = p.device_id AND v.route_edge_id = p.route_edge_id)""", *NEED))
def unvoted_edges(t: Tables):
    return ops.unvoted(ops.overlapping(edges(t), segments(t), ["device_id"]), t.route_votes).select("device_id", "line_id", "route_edge_id")


@query("j07_lines_near_trips", with_tables(f"""WITH near AS (SELECT DISTINCT s.trace_id AS device_id, e.line_id FROM trip_segments s JOIN edge_segments e
      ON s.x1 <= greatest(e.x1, e.x2) + 2000 AND s.x1 >= least(e.x1, e.x2) - 2000 AND {seg_seg('s', 'e')} <= 200.0)
    SELECT n.device_id, n.line_id, l.name FROM near n JOIN lines l USING (line_id)
    WHERE NOT EXISTS (SELECT 1 FROM trips r WHERE r.device_id = n.device_id AND r.line_id = n.line_id)
      AND NOT EXISTS (SELECT 1 FROM line_votes v WHERE v.device_id = n.device_id AND v.line_id = n.line_id)""",
    *NEED, "lines", "trips", "line_votes"))
def lines_near_trips(t: Tables):
    return ops.nearby_lines(edges(t), segments(t), t.trips, t.line_vote_events, t.lines)


def stops(t: Tables):
    return t.raw("supplier").selectExpr(
        "s_suppkey AS point_id", "cast(-66.20 AS double) + cast(0.001 AS double) * (s_suppkey % 97) AS lon",
        "cast(-17.40 AS double) + cast(0.001 AS double) * (s_suppkey % 31) AS lat")


STOPS = """stops AS (SELECT s_suppkey AS point_id, CAST(-66.20 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (s_suppkey % 97) AS lon,
    CAST(-17.40 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (s_suppkey % 31) AS lat FROM supplier)"""
EAST = "(({0} - p.lon) * cos(radians(p.lat)) * 111320.0)"
NORTH = "(({0} - p.lat) * 111320.0)"
GAP = point_seg("0.0", "0.0", EAST.format("e.lon1"), NORTH.format("e.lat1"), EAST.format("e.lon2"), NORTH.format("e.lat2"))
NEAR = f"""{STOPS}, near AS (SELECT point_id, line_id, min(d) AS d FROM (SELECT p.point_id, e.line_id, {GAP} AS d FROM stops p, route_edges e) WHERE d <= 500 GROUP BY 1, 2)"""


@query("j08_lines_near_points", with_tables(f"WITH {NEAR} SELECT point_id, line_id, round(d, 3) AS distance_m FROM near", "route_edges"))
def lines_near_points(t: Tables):
    return ops.lines_near_points(stops(t), t.route_edges).withColumn("distance_m", F.round("distance_m", 3))


@query("j08_nearby_report", with_tables(f"""WITH {NEAR} SELECT n.point_id, n.line_id, l.name, l.line_type, v.variants, d.active_detour
    FROM near n JOIN lines l USING (line_id)
    LEFT JOIN (SELECT line_id, string_agg(ramal_label, ',' ORDER BY ramal_label) AS variants FROM routes WHERE status <> 'superseded' GROUP BY 1) v USING (line_id)
    LEFT JOIN (SELECT line_id, max_by(detour_id, (last_confirmed_at, detour_id)) AS active_detour FROM detours WHERE status = 'active' GROUP BY 1) d USING (line_id)
    WHERE l.status = 'approved'""", "routes", "lines", "detours"))
def nearby_report(t: Tables):
    from colectivo.operators import schedules

    live = t.routes.where("status IN ('confirmed', 'pending')").select("route_id")
    near = ops.lines_near_points(stops(t), t.route_edges.join(live, "route_id", "left_semi"))
    hours = schedules.infer_schedules(t.lines, t.sessions)
    out = ops.nearby_report(near, t.lines.where("status = 'approved'"), t.routes, t.detours, hours)
    labels = F.array_join(F.transform("variants", lambda v: v["ramal_label"]), ",")
    return out.select("point_id", "line_id", "name", "line_type", labels.alias("variants"), "active_detour")


@query("j19_device_segments", with_tables(f"""WITH {pairs(50.0)}, n AS (SELECT device_id, line_id, count(*) AS trips FROM trips WHERE status = 'clean' GROUP BY 1, 2),
    live AS (SELECT line_id, min_by(route_id, (-version, route_id)) AS route_id FROM routes WHERE status <> 'superseded' GROUP BY 1)
    SELECT n.device_id, n.line_id, n.trips, n.trips >= 3 AS eligible, count(p.route_edge_id) AS edges, min(p.sequence) AS first_sequence FROM n LEFT JOIN (
      SELECT p.* FROM pairs p JOIN route_edges e USING (route_edge_id) JOIN live l ON l.line_id = e.line_id AND l.route_id = e.route_id
      WHERE NOT EXISTS (SELECT 1 FROM route_votes v WHERE v.device_id = p.device_id AND v.route_edge_id = p.route_edge_id)) p ON p.device_id = n.device_id AND p.line_id = n.line_id AND n.trips >= 3 GROUP BY 1, 2, 3, 4""",
    *NEED, "trips", "routes", "route_votes"))
def device_segments(t: Tables):
    from colectivo.operators import listings

    state, shown = listings.device_segments(t.routes, t.route_edges, ops.overlapping(edges(t), segments(t), ["device_id"]), t.route_votes, device_trips(t))
    sums = shown.groupBy("device_id", "line_id").agg(F.count(F.lit(1)).alias("edges"), F.min("sequence").alias("first_sequence"))
    return state.join(sums, ["device_id", "line_id"], "left").fillna(0, ["edges"])


@query("w04_voteable_sections", with_tables(f"""WITH {pairs(50.0)}, runs AS (SELECT *, sequence - row_number() OVER (PARTITION BY device_id, line_id ORDER BY sequence) AS run FROM pairs)
    SELECT device_id, line_id, dense_rank() OVER (PARTITION BY device_id, line_id ORDER BY run) - 1 AS section_index, count(*) AS edges, min(sequence) AS first_sequence,
    1 AS trips, count(*) + 1 AS vertices FROM runs GROUP BY device_id, line_id, run""", *NEED))
def voteable_sections(t: Tables):
    shaped = t.route_edges.selectExpr("route_edge_id", "sequence",
                                      "array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon2, 'lat', lat2)) AS path")
    # One search gives both: a device runs along the edges of its trips.
    per_trip = snapshot(ops.overlapping(edges(t), segments(t), ["device_id", "session_id"]).withColumnRenamed("session_id", "trip_id"))
    mine = per_trip.select("device_id", "line_id", "route_edge_id").distinct()
    out = ops.voteable_sections(mine, per_trip.drop("line_id"), shaped)
    return out.select("device_id", "line_id", "section_index", "edges", "first_sequence", "trips", F.size("geometry").alias("vertices"))


@query("l08_cast_votes", with_tables(f"""WITH {pairs(50.0)}, heard AS (SELECT line_id, device_id FROM trips WHERE status = 'clean' GROUP BY 1, 2 HAVING count(*) >= 3),
    ballots AS (SELECT trace_id AS device_id, line_id, CASE WHEN event_id % 4 = 1 THEN 'reject' ELSE 'approve' END AS vote, ts AS created_at FROM trace_points),
    spread AS (SELECT p.route_edge_id, b.device_id, b.vote, b.created_at FROM ballots b JOIN heard USING (device_id, line_id) JOIN pairs p ON p.device_id = b.device_id AND p.line_id = b.line_id),
    latest AS (SELECT route_edge_id, device_id, max_by(vote, (created_at, vote)) AS vote FROM (SELECT * FROM spread UNION ALL SELECT route_edge_id, device_id, vote, created_at FROM route_votes) GROUP BY 1, 2)
    SELECT route_edge_id, count(*) FILTER (WHERE vote = 'approve') AS votes_for, count(*) FILTER (WHERE vote = 'reject') AS votes_against FROM latest GROUP BY 1""",
    *NEED, "trips"))
def cast_votes(t: Tables):
    from colectivo.operators import votes

    ballots = t.trace_points.selectExpr(
        "trace_id AS device_id", "line_id", "CASE WHEN event_id % 4 = 1 THEN 'reject' ELSE 'approve' END AS vote", "ts AS created_at")
    current = t.route_votes.select("route_edge_id", "device_id", "vote", "created_at")
    after = votes.cast_votes(current, ballots, ops.overlapping(edges(t), segments(t), ["device_id"]), device_trips(t))
    return votes.tallies(after, "route_edge_id")


@query("a19_session_blocks", with_tables(f"""WITH {pairs(50.0)}, pos AS (SELECT line_id, device_id AS session_id, avg(sequence) AS position FROM pairs GROUP BY 1, 2),
    ranked AS (SELECT s.line_id, s.session_id, position, row_number() OVER (PARTITION BY s.line_id ORDER BY coalesce(position, 'infinity'), s.session_id) - 1 AS place, count(*) OVER (PARTITION BY s.line_id) AS total
      FROM (SELECT DISTINCT line_id, trace_id AS session_id FROM trace_points) s LEFT JOIN pos ON pos.line_id = s.line_id AND pos.session_id = s.session_id)
    SELECT line_id, session_id, round(position, 6) AS position, (place * least(8, total)) // total AS block FROM ranked""", *NEED))
def session_blocks(t: Tables):
    per_session = ops.overlapping(edges(t), segments(t), ["session_id"])
    positions = ops.route_positions(per_session, t.route_edges)
    all_sessions = t.trace_points.selectExpr("line_id", "trace_id AS session_id").distinct()
    return ops.voter_blocks(all_sessions, positions, 8).withColumn("position", F.round("position", 6))


@query("a20_fit_ratio", with_tables(f"""WITH {pairs(25.0)}, voted AS (SELECT DISTINCT device_id, route_edge_id FROM route_votes)
    SELECT v.device_id, round(count(p.route_edge_id) / CAST(count(*) AS DOUBLE), 6) AS fit_ratio, count(*) AS edges
    FROM voted v LEFT JOIN pairs p ON p.device_id = v.device_id AND p.route_edge_id = v.route_edge_id GROUP BY 1""", *NEED))
def fit_ratio(t: Tables):
    tight = ops.overlapping(edges(t), segments(t), ["device_id"], d=25.0)
    return ops.fit_ratio(t.route_votes, tight, tight, ["device_id"]).withColumn("fit_ratio", F.round("fit_ratio", 6))


ACTIVE = """active AS (SELECT line_id, min_by(route_id, (-version, route_id)) AS route_id FROM routes WHERE status <> 'superseded' GROUP BY 1)"""


@query("a24_vote_worklist", with_tables(f"""WITH {pairs(50.0)}, {ACTIVE}, act AS (SELECT e.* FROM route_edges e JOIN active USING (line_id, route_id)),
    tc AS (SELECT line_id, device_id, count(*) AS trips FROM trips WHERE status = 'clean' GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT p.device_id, p.line_id, tc.trips, count(*) AS pending_edges, (SELECT count(*) FROM act a WHERE a.line_id = p.line_id) AS total_edges
    FROM pairs p JOIN act a ON a.route_edge_id = p.route_edge_id JOIN tc ON tc.device_id = p.device_id AND tc.line_id = p.line_id
    WHERE NOT EXISTS (SELECT 1 FROM route_votes v WHERE v.device_id = p.device_id AND v.route_edge_id = p.route_edge_id) GROUP BY 1, 2, 3""",
    *NEED, "routes", "trips"))
def vote_worklist(t: Tables):
    active = listings.active_route_per_line(t.routes).select("route_id")
    mine = t.route_edges.join(active, "route_id", "left_semi")
    overlaps = ops.overlapping(ops.to_mercator(mine), segments(t), ["device_id"])
    return ops.vote_worklist(mine, overlaps, t.route_votes, device_trips(t))


@query("a26_voter_views", with_tables("""WITH placed AS (SELECT v.device_id, v.vote, e.* FROM route_votes v JOIN route_edges e USING (route_edge_id)),
    runs AS (SELECT *, sequence - row_number() OVER (PARTITION BY device_id, route_id ORDER BY sequence) AS run FROM placed),
    secs AS (SELECT device_id, route_id, run, CASE WHEN count(*) FILTER (WHERE vote = 'approve') > count(*) / 2.0 THEN 1 ELSE 0 END AS yes FROM runs GROUP BY 1, 2, 3),
    per AS (SELECT device_id, route_id, count(*) AS sections, sum(yes) AS approving_sections FROM secs GROUP BY 1, 2),
    tot AS (SELECT device_id, route_id, line_id, count(*) FILTER (WHERE vote = 'approve') AS approve, count(*) FILTER (WHERE vote = 'reject') AS reject,
      min(least(lon1, lon2)) AS a, max(greatest(lon1, lon2)) AS b, min(least(lat1, lat2)) AS c, max(greatest(lat1, lat2)) AS d FROM placed GROUP BY 1, 2, 3),
    bnd AS (SELECT trace_id AS device_id, line_id, min(lon) AS a2, max(lon) AS b2, min(lat) AS c2, max(lat) AS d2 FROM trace_points GROUP BY 1, 2),
    tc AS (SELECT device_id, line_id, count(*) AS trips FROM trips WHERE status = 'clean' GROUP BY 1, 2)
    SELECT t.device_id, t.route_id, t.line_id, approve, reject, sections, CAST(approving_sections AS BIGINT) AS approving_sections, coalesce(trips, 0) AS trips,
      round(least(a, a2), 6) AS min_lon, round(greatest(b, b2), 6) AS max_lon, round(least(c, c2), 6) AS min_lat, round(greatest(d, d2), 6) AS max_lat
    FROM tot t JOIN per USING (device_id, route_id) LEFT JOIN bnd USING (device_id, line_id) LEFT JOIN tc USING (device_id, line_id)""",
    "route_edges", "route_votes", "trips"))
def voter_views(t: Tables):
    bounds = t.trace_points.groupBy(F.col("trace_id").alias("device_id"), "line_id").agg(
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))
    out = ops.voter_views(t.route_votes, t.route_edges, device_trips(t), bounds)
    return out.withColumns({c: F.round(c, 6) for c in ("min_lon", "max_lon", "min_lat", "max_lat")})
