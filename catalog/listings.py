from pyspark.sql import functions as F

from catalog import query
from colectivo.operators import listings as ops
from colectivo.operators import ordered
from fixtures import Tables, hav, with_tables

LEN = f"""steps AS (SELECT trace_id, line_id, point_index, {hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS d FROM trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY point_index))"""


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


@query("j01_fk_chain", with_tables("""SELECT l.line_id, r.route_id, e.route_edge_id, v.device_id, v.vote FROM lines l JOIN routes r USING (line_id)
    JOIN route_edges e USING (route_id) JOIN route_votes v USING (route_edge_id)""", "lines", "routes", "route_votes"))
def fk_chain(t: Tables):
    return (t.lines.select("line_id").join(t.routes.select("line_id", "route_id"), "line_id")
            .join(t.route_edges.select("route_id", "route_edge_id"), "route_id")
            .join(t.route_votes.select("route_edge_id", "device_id", "vote"), "route_edge_id")
            .select("line_id", "route_id", "route_edge_id", "device_id", "vote"))


@query("j02_sessions_with_lines_and_trips", with_tables("""SELECT s.session_id, l.name AS line_name, t.trip_id, t.match_score FROM sessions s
    LEFT JOIN lines l ON l.line_id = s.line_id LEFT JOIN trips t ON t.session_id = s.session_id""", "sessions", "lines", "trips"))
def sessions_with_trips(t: Tables):
    return ops.sessions_with_trips(t.sessions, t.lines, t.trips).select("session_id", "line_name", "trip_id", "match_score")


@query("j03_unvoted_unridden_lines", with_tables("""SELECT d.device_id, l.line_id FROM (SELECT DISTINCT device_id, line_id AS home FROM sessions) d
    JOIN lines l ON l.line_id BETWEEN d.home AND d.home + 7 AND l.status = 'approved'
    WHERE NOT EXISTS (SELECT 1 FROM trips t WHERE t.device_id = d.device_id AND t.line_id = l.line_id)
    AND NOT EXISTS (SELECT 1 FROM line_votes v WHERE v.device_id = d.device_id AND v.line_id = l.line_id)""", "sessions", "trips", "lines", "line_votes"))
def unvoted_unridden(t: Tables):
    offers = t.sessions.select("device_id", "line_id").distinct().selectExpr(
        "device_id", "explode(sequence(line_id, line_id + 7)) AS line_id")
    return (offers.join(t.lines.where("status = 'approved'").select("line_id"), "line_id", "left_semi")
            .join(t.trips.select("device_id", "line_id"), ["device_id", "line_id"], "left_anti")
            .join(t.line_vote_events.select("device_id", "line_id"), ["device_id", "line_id"], "left_anti")
            .select("device_id", "line_id"))


@query("j04_lines_without_route", with_tables("""SELECT count(*) AS n FROM lines WHERE status = 'approved'
    AND line_id NOT IN (SELECT line_id FROM routes WHERE status <> 'superseded')""", "lines", "routes"))
def lines_without_route(t: Tables):
    return ops.lines_without_route(t.lines, t.routes).agg(F.count(F.lit(1)).alias("n"))


@query("j15_subscribers", with_tables("""WITH subs AS (SELECT c_custkey AS device_id, c_custkey % 5 AS line_id FROM customer),
    devs AS (SELECT c_custkey AS device_id FROM customer WHERE c_acctbal >= 0)
    SELECT e.event_id AS report_id, s.device_id FROM detour_events e JOIN subs s ON s.line_id = e.line_id JOIN devs v ON v.device_id = s.device_id
    WHERE s.device_id <> e.device_id""", "detour_events"))
def subscribers(t: Tables):
    people = t.raw("customer")
    subs = people.selectExpr("c_custkey AS device_id", "c_custkey % 5 AS line_id")
    devices = people.selectExpr("c_custkey AS device_id", "CASE WHEN c_acctbal >= 0 THEN 'token' END AS push_token")
    reports = t.detour_events.selectExpr("event_id AS report_id", "line_id", "device_id AS reporter")
    return ops.subscribers(reports, subs, devices).select("report_id", "device_id")


@query("j17_latest_version_coordinates", with_tables("""WITH latest AS (SELECT line_id, ramal_label, max_by(route_id, (version, route_id)) AS route_id FROM routes GROUP BY 1, 2)
    SELECT l.line_id, l.ramal_label, l.route_id, count(*) + 1 AS vertices, round(min(lon1), 6) AS first_lon, round(max(lon2), 6) AS last_lon
    FROM latest l JOIN route_edges e USING (route_id) GROUP BY 1, 2, 3""", "routes", "route_edges"))
def latest_coordinates(t: Tables):
    shaped = t.route_edges.selectExpr("route_id", "sequence", "array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon2, 'lat', lat2)) AS path")
    out = ops.route_coordinates(ops.latest_version_per_variant(t.routes), shaped)
    return out.select("line_id", "ramal_label", "route_id", F.size("path").alias("vertices"),
                      F.round(F.element_at("path", 1)["lon"], 6).alias("first_lon"), F.round(F.element_at("path", -1)["lon"], 6).alias("last_lon"))


@query("j18_raw_clean_pairs", with_tables("""SELECT coalesce(r.session_id, t.session_id) AS session_id, t.trip_id,
    CASE WHEN r.session_id IS NULL THEN 'clean_only' WHEN t.trip_id IS NULL THEN 'raw_only' ELSE 'paired' END AS kind
    FROM (SELECT * FROM sessions WHERE session_id % 10 > 0) r FULL JOIN trips t ON t.session_id = r.session_id""", "sessions", "trips"))
def raw_clean_pairs(t: Tables):
    return ops.raw_clean_pairs(t.sessions.where("session_id % 10 > 0"), t.trips)


@query("j19_session_listing", with_tables("""SELECT s.session_id, s.device_id, coalesce(p.n, 0) AS point_count, t.trip_id IS NOT NULL AS has_trip, t.match_score
    FROM sessions s LEFT JOIN (SELECT trace_id, count(*) AS n FROM trace_points GROUP BY 1) p ON p.trace_id = s.session_id LEFT JOIN trips t USING (session_id)""",
    "sessions", "trips", "trace_points"))
def session_listing(t: Tables):
    counts = t.trace_points.groupBy(F.col("trace_id").alias("session_id")).agg(F.count(F.lit(1)).alias("point_count"))
    return ops.session_listing(t.sessions, t.trips, counts).select("session_id", "device_id", "point_count", "has_trip", "match_score")


@query("j19_trips_with_score", with_tables("SELECT trip_id, line_id, status, match_score FROM trips WHERE match_score >= 0.5", "trips"))
def trips_with_score(t: Tables):
    return ops.trips_with_score(t.trips, 0.5).select("trip_id", "line_id", "status", "match_score")


@query("j19_route_versions", with_tables("""SELECT r.route_id, r.version, r.status, coalesce(e.n, 0) AS edges FROM routes r
    LEFT JOIN (SELECT route_id, count(*) AS n FROM route_edges GROUP BY 1) e USING (route_id)""", "routes", "route_edges"))
def route_versions(t: Tables):
    return ops.route_versions(t.routes, t.route_edges).select("route_id", "version", "status", "edges")


@query("j19_route_edges", with_tables("""WITH live AS (SELECT line_id, min_by(route_id, (-version, route_id)) AS route_id FROM routes WHERE status <> 'superseded' GROUP BY 1),
    asked AS (SELECT line_id, CASE WHEN line_id % 2 = 0 THEN line_id * 10 + 2 ELSE route_id END AS route_id FROM live),
    v AS (SELECT route_edge_id, count(*) FILTER (WHERE vote = 'approve') AS f, count(*) FILTER (WHERE vote = 'reject') AS a FROM route_votes GROUP BY 1)
    SELECT e.line_id, e.route_id, e.route_edge_id, sequence, edge_id, coalesce(f, 0) AS votes_for, coalesce(a, 0) AS votes_against FROM asked JOIN route_edges e USING (line_id, route_id) LEFT JOIN v USING (route_edge_id)""", "routes", "route_edges", "route_votes"))
def route_edge_listing(t: Tables):
    """Even lines show their third lane, the others their latest live route."""
    chosen = t.lines.selectExpr("line_id", "line_id * 10 + CASE WHEN line_id % 2 = 0 THEN 2 ELSE 999 END AS route_id")
    out = ops.route_edge_listing(t.routes, t.route_edges, t.route_votes, chosen)
    return out.select("line_id", "route_id", "route_edge_id", "sequence", "edge_id", "votes_for", "votes_against")


@query("a02_lines_ready", with_tables("""SELECT line_id, count(*) AS trips FROM trips WHERE status = 'clean' AND line_id IN (SELECT line_id FROM lines WHERE status = 'approved')
    GROUP BY 1 HAVING count(*) >= 3""", "trips", "lines"))
def lines_ready(t: Tables):
    return ops.lines_ready(t.lines, t.trips)


@query("a03_lines_with_raw_sessions", with_tables("SELECT line_id FROM sessions WHERE status = 'completed' AND processing_status = 'raw' GROUP BY 1", "sessions"))
def raw_lines(t: Tables):
    return ops.lines_with_raw_sessions(t.sessions)


@query("a12_device_trip_counts", with_tables("SELECT device_id, line_id, count(*) AS trips, count(*) >= 3 AS eligible FROM trips GROUP BY 1, 2", "trips"))
def device_trip_counts(t: Tables):
    return ops.device_trip_counts(t.trips)


@query("a12_eligible_devices", with_tables("SELECT line_id, count(*) AS devices FROM (SELECT line_id FROM trips GROUP BY device_id, line_id HAVING count(*) >= 3) GROUP BY 1", "trips"))
def eligible_devices(t: Tables):
    return ops.eligible_devices(t.trips)


@query("a15_fleet_dashboard", with_tables("""SELECT (SELECT count(*) FROM lines WHERE status = 'approved') AS approved_lines, (SELECT count(*) FROM lines WHERE status = 'pending') AS pending_lines,
    (SELECT count(*) FROM sessions WHERE status = 'completed') AS completed_sessions, (SELECT count(*) FROM trips) AS trips,
    (SELECT count(*) FROM routes WHERE status <> 'superseded') AS active_routes, (SELECT count(*) FROM routes WHERE status <> 'superseded' AND fragment_count > 1) AS fragmented_routes,
    (SELECT count(*) FROM lines WHERE status = 'approved' AND line_id NOT IN (SELECT line_id FROM routes WHERE status <> 'superseded')) AS lines_without_route""",
    "lines", "sessions", "trips", "routes"))
def fleet_dashboard(t: Tables):
    return ops.fleet_dashboard(t.lines, t.sessions, t.trips, t.routes)


@query("a16_line_overview", with_tables("""SELECT l.line_id, l.name, coalesce(s.n, 0) AS sessions, coalesce(t.n, 0) AS trips, coalesce(r.n, 0) AS active_routes, r.v AS route_version
    FROM lines l LEFT JOIN (SELECT line_id, count(*) AS n FROM sessions GROUP BY 1) s USING (line_id) LEFT JOIN (SELECT line_id, count(*) AS n FROM trips GROUP BY 1) t USING (line_id)
    LEFT JOIN (SELECT line_id, count(*) AS n, max(version) AS v FROM routes WHERE status <> 'superseded' GROUP BY 1) r USING (line_id)""",
    "lines", "sessions", "trips", "routes"))
def line_overview(t: Tables):
    return ops.line_overview(t.lines, t.sessions, t.trips, t.routes).select("line_id", "name", "sessions", "trips", "active_routes", "route_version")


@query("a17_device_overview", with_tables("""WITH per AS (SELECT device_id, line_id, count(*) AS n FROM trips WHERE status = 'clean' GROUP BY 1, 2),
    tal AS (SELECT device_id, sum(n) AS clean_trips, bool_or(n >= 3) AS any_eligible, string_agg(line_id || ':' || n, ',' ORDER BY line_id) AS per_line FROM per GROUP BY 1)
    SELECT s.device_id, s.n AS sessions, CAST(coalesce(clean_trips, 0) AS BIGINT) AS clean_trips, coalesce(any_eligible, false) AS any_eligible, per_line
    FROM (SELECT device_id, count(*) AS n FROM sessions GROUP BY 1) s LEFT JOIN tal USING (device_id)""", "sessions", "trips"))
def device_overview(t: Tables):
    text = F.array_join(F.transform("per_line", lambda p: F.concat_ws(":", p["line_id"], p["trips"])), ",")
    return ops.device_overview(t.sessions, t.trips).withColumn("per_line", text)


@query("a18_session_totals", with_tables(f"""WITH {LEN}, lens AS (SELECT trace_id, count(*) AS points, coalesce(sum(d), 0) AS m FROM steps GROUP BY 1)
    SELECT s.session_id, coalesce(points, 0) AS points, round(coalesce(m, 0), 3) AS distance_m,
    round((epoch_us(coalesce(ended_at, last_activity_at)) - epoch_us(s.started_at)) / 1000000.0, 3) AS duration_s, t.match_score AS best_score
    FROM sessions s LEFT JOIN lens l ON l.trace_id = s.session_id LEFT JOIN trips t USING (session_id)""", "sessions", "trips", "trace_points"))
def session_totals(t: Tables):
    lengths = ops.track_lengths(t.trace_points.withColumnRenamed("trace_id", "session_id"), ["session_id"])
    out = ops.session_totals(t.sessions, lengths, t.trips)
    return out.withColumns({"distance_m": F.round("distance_m", 3), "duration_s": F.round("duration_s", 3)})


@query("a21_segment_density", with_tables("""WITH mids AS (SELECT trace_id, CAST(round(CAST((lon + lead(lon) OVER w) / 2 AS DECIMAL(12,8)), 4) AS DOUBLE) AS mid_lon, CAST(round(CAST((lat + lead(lat) OVER w) / 2 AS DECIMAL(12,8)), 4) AS DOUBLE) AS mid_lat
      FROM trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY point_index))
    SELECT mid_lon, mid_lat, count(DISTINCT trace_id) AS traces FROM mids WHERE mid_lon IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT trace_id) >= 2""", "trace_points"))
def segment_density(t: Tables):
    return ops.segment_density(t.trace_points, ["trace_id"], min_count=2)


@query("a22_run_summary", with_tables(f"""WITH {LEN}, lens AS (SELECT trace_id, coalesce(sum(d), 0) AS m FROM steps GROUP BY 1),
    res AS (SELECT ramal_label, trip_count * 10.0 AS f FROM routes)
    SELECT round(avg(m), 1) AS trace_distance_mean_m, round(median(m), 1) AS trace_distance_median_m, round(stddev_samp(m), 1) AS trace_distance_std_m,
    (SELECT count(DISTINCT ramal_label) FROM res WHERE f <= 60) AS variants_found, (SELECT count(*) FROM res) AS routes, CAST((SELECT min(f) FROM res) AS DOUBLE) AS best_overlap_m,
    round((SELECT count(DISTINCT device_id) FROM route_votes) / CAST((SELECT count(DISTINCT device_id) FROM sessions) AS DOUBLE), 4) AS turnout,
    (SELECT count(*) FROM route_votes) AS votes_total, (SELECT count(*) FROM route_votes WHERE vote = 'approve') AS votes_for,
    (SELECT count(*) FROM route_votes WHERE vote = 'reject') AS votes_against FROM lens""", "trace_points", "routes", "route_votes", "sessions"))
def run_summary(t: Tables):
    lengths = ops.track_lengths(t.trace_points, ["trace_id"])
    results = t.routes.selectExpr("ramal_label AS matched_variant", "cast(trip_count * 10.0 AS double) AS frechet_overlap_m")
    return ops.run_summary(lengths, results, t.route_votes, t.sessions)


@query("a23_trace_quality", with_tables(f"""WITH p AS (SELECT trace_id, point_index, event_id, ts, lon, lat, CAST(event_id % 13 AS DOUBLE) - 6 + CASE WHEN event_id % 41 = 0 THEN 200.0 ELSE 0.0 END AS o FROM trace_points),
    st AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0 AS gap0, {hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS step FROM p WINDOW w AS (PARTITION BY trace_id ORDER BY point_index)),
    sg AS (SELECT *, CASE WHEN gap0 > 0 THEN gap0 END AS gap, median(CASE WHEN gap0 > 0 THEN gap0 END) OVER (PARTITION BY trace_id) AS iv FROM st),
    tm AS (SELECT trace_id, max(iv) AS interval_s, CASE WHEN count(CASE WHEN gap < 1.5 * iv THEN gap END) >= 2 THEN stddev_pop(CASE WHEN gap < 1.5 * iv THEN gap END) END AS jitter_s,
      sum(greatest(0, round_even(gap / iv, 0) - 1)) / (count(gap) + sum(greatest(0, round_even(gap / iv, 0) - 1))) AS missing_share,
      sum(step) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS speed_m_s, stddev_pop(step) / avg(step) AS step_speed_cv,
      regr_slope(o, point_index) AS drift_per_point, regr_intercept(o, point_index) AS bias_m FROM sg GROUP BY 1),
    rs AS (SELECT p.trace_id, o - bias_m - drift_per_point * point_index AS r FROM p JOIN tm USING (trace_id)),
    md AS (SELECT trace_id, r, median(r) OVER (PARTITION BY trace_id) AS c FROM rs),
    ma AS (SELECT trace_id, r, abs(r - c) AS far, median(abs(r - c)) OVER (PARTITION BY trace_id) AS mad FROM md),
    fl AS (SELECT trace_id, r, far > 4.0 * greatest(mad * 1.4826, 1e-6) AS out FROM ma),
    oo AS (SELECT trace_id, stddev_pop(CASE WHEN NOT out THEN r END) AS residual_spread_m, avg(CAST(out AS DOUBLE)) AS outlier_share, avg(CASE WHEN out THEN abs(r) END) AS outlier_size_m FROM fl GROUP BY 1)
    SELECT trace_id, round(interval_s, 3) AS interval_s, round(jitter_s, 3) AS jitter_s, round(missing_share, 6) AS missing_share, round(speed_m_s, 6) AS speed_m_s, round(step_speed_cv, 6) AS step_speed_cv,
    round(drift_per_point, 6) AS drift_per_point, round(bias_m, 4) AS bias_m, round(residual_spread_m, 4) AS residual_spread_m, round(outlier_share, 6) AS outlier_share, round(outlier_size_m, 4) AS outlier_size_m
    FROM tm JOIN oo USING (trace_id)""", "trace_points"))
def trace_quality(t: Tables):
    points = t.trace_points.selectExpr(
        "trace_id", "point_index", "ts", "lon", "lat",
        "cast(event_id % 13 AS double) - 6 + CASE WHEN event_id % 41 = 0 THEN 200.0D ELSE 0.0D END AS offset_m")
    out = ops.quality_profile(points, ["trace_id"])
    digits = {"interval_s": 3, "jitter_s": 3, "bias_m": 4, "residual_spread_m": 4, "outlier_size_m": 4}
    return out.select("trace_id", *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns if c != "trace_id"])


@query("o01_newest_sessions_page", with_tables("SELECT session_id, line_id, CAST(date_trunc('second', started_at) AS VARCHAR) AS started_at FROM sessions ORDER BY sessions.started_at DESC, session_id DESC LIMIT 100 OFFSET 200", "sessions"))
def newest_page(t: Tables):
    return ops.page(t.sessions, [F.desc("started_at"), F.desc("session_id")], 200, 100).select("session_id", "line_id", stamp("started_at").alias("started_at"))


@query("o03_recent_reports", with_tables("SELECT report_id, line_id FROM fare_reports ORDER BY created_at DESC, report_id DESC LIMIT 10", "fare_reports"))
def recent_reports(t: Tables):
    return ops.recent(t.fare_reports, "created_at", "report_id", 10).select("report_id", "line_id")


@query("u01_device_ids", with_tables("SELECT device_id FROM sessions UNION SELECT device_id FROM edge_vote_events UNION SELECT device_id FROM line_vote_events UNION SELECT device_id FROM fare_reports",
    "sessions", "edge_vote_events", "line_vote_events", "fare_reports"))
def device_ids(t: Tables):
    return ops.device_ids(t.sessions, t.edge_vote_events, t.line_vote_events, t.fare_reports)


@query("w08_next_version", with_tables("SELECT line_id, ramal_label, max(version) + 1 AS next_version FROM routes GROUP BY 1, 2", "routes"))
def next_version(t: Tables):
    return ops.next_version(t.routes)


@query("w08_active_route", with_tables("SELECT line_id, min_by(route_id, (-version, route_id)) AS route_id FROM routes WHERE status <> 'superseded' GROUP BY 1", "routes"))
def active_route(t: Tables):
    return ops.active_route_per_line(t.routes).select("line_id", "route_id")


@query("w12_trip_endpoints", with_tables("""SELECT trace_id, round(min_by(lon, point_index), 6) AS first_lon, round(min_by(lat, point_index), 6) AS first_lat,
    round(max_by(lon, point_index), 6) AS last_lon, round(max_by(lat, point_index), 6) AS last_lat FROM trace_points GROUP BY 1""", "trace_points"))
def trip_endpoints(t: Tables):
    return t.trace_points.groupBy("trace_id").agg(
        F.round(F.min_by("lon", "point_index"), 6).alias("first_lon"), F.round(F.min_by("lat", "point_index"), 6).alias("first_lat"),
        F.round(F.max_by("lon", "point_index"), 6).alias("last_lon"), F.round(F.max_by("lat", "point_index"), 6).alias("last_lat"))
