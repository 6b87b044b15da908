"""Cleaning and edge-sequence queries."""

from pyspark.sql import functions as F

from catalog import query
from colectivo.functions import geo
from colectivo.operators import cleaning as ops
from colectivo.operators import ordered
from fixtures import Tables, hav, point_seg, with_tables

KEYS = ["trace_id"]


def coarse_edges(t: Tables):
    """Edge rows where neighbours repeat, so collapsing has work to do."""
    return t.trace_edges.withColumn("edge_id", F.floor(F.col("edge_id") / 3).cast("bigint"))


def shaped_edges(t: Tables):
    path = F.expr("array(named_struct('lon', cast(seq AS double), 'lat', 0D), named_struct('lon', cast(seq + 1 AS double), 'lat', 0D))")
    return coarse_edges(t).withColumn("path", path)


COARSE = "ce AS (SELECT trace_id, seq, edge_id // 3 AS edge_id, lag(edge_id // 3) OVER (PARTITION BY trace_id ORDER BY seq) AS prev FROM trace_edges)"


@query("m01_thin_points", with_tables(f"""WITH RECURSIVE p AS (SELECT trace_id, point_index AS k, lon, lat, ts FROM trace_points),
    walk AS (SELECT trace_id, k, lon, lat, ts, true AS kept FROM p WHERE k = 0
      UNION ALL SELECT trace_id, k, CASE WHEN kept THEN plon ELSE lon END, CASE WHEN kept THEN plat ELSE lat END, CASE WHEN kept THEN pts ELSE ts END, kept FROM (
        SELECT p.trace_id, p.k, w.lon, w.lat, w.ts, p.lon AS plon, p.lat AS plat, p.ts AS pts, {hav('w.lon', 'w.lat', 'p.lon', 'p.lat')} >= 5.0 OR p.ts - w.ts >= INTERVAL 30 SECOND AS kept FROM walk w JOIN p ON p.trace_id = w.trace_id AND p.k = w.k + 1))
    SELECT trace_id, count(*) FILTER (WHERE kept OR k = (SELECT max(k) FROM p WHERE p.trace_id = walk.trace_id)) AS kept FROM walk GROUP BY 1""", "trace_points"))
def thin_points(t: Tables):
    return ops.thin(t.trace_points, KEYS).groupBy("trace_id").agg(F.count(F.lit(1)).alias("kept"))


@query("m02_drop_spikes", with_tables(f"""WITH v AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lag(snap_m) OVER w AS ps, lead(snap_m) OVER w AS ns
      FROM matched_points WHERE type <> 'unmatched' WINDOW w AS (PARTITION BY trace_id ORDER BY point_index)),
    m AS (SELECT *, 111320.0 * cos(radians((plat + lat + nlat) / 3)) AS k FROM v),
    j AS (SELECT *, plon IS NOT NULL AND nlon IS NOT NULL AND snap_m >= 15 AND snap_m >= greatest(ps, ns) + 6
      AND {point_seg('(lon * k)', '(lat * 111320.0)', '(plon * k)', '(plat * 111320.0)', '(nlon * k)', '(nlat * 111320.0)')} >= 12
      AND ((lon-plon)*(nlon-lon) + (lat-plat)*(nlat-lat)) / (sqrt(pow(lon-plon,2)+pow(lat-plat,2)) * sqrt(pow(nlon-lon,2)+pow(nlat-lat,2))) <= 0.4
      AND {hav('plon', 'plat', 'lon', 'lat')} + {hav('lon', 'lat', 'nlon', 'nlat')} > {hav('plon', 'plat', 'nlon', 'nlat')} + 15 AND NOT accuracy <= 10 AS spike FROM m)
    SELECT trace_id, point_index FROM j WHERE NOT coalesce(spike, false)""", "matched_points"))
def drop_spikes(t: Tables):
    return ops.drop_spikes(t.matched_points, KEYS).select("trace_id", "point_index")


@query("f19_match_metrics", with_tables("""SELECT trace_id, count(*) AS points, round(count(*) FILTER (WHERE type = 'matched') / CAST(count(*) AS DOUBLE), 6) AS match_score,
    round(1 - count(*) FILTER (WHERE type = 'unmatched') / CAST(count(*) AS DOUBLE), 6) AS quality, round(coalesce(avg(CASE WHEN type = 'matched' THEN snap_m END), 0), 6) AS mean_snap_m FROM matched_points GROUP BY 1""", "matched_points"))
def match_metrics(t: Tables):
    out = ops.match_metrics(t.matched_points, KEYS)
    return out.withColumns({c: F.round(c, 6) for c in ("match_score", "quality", "mean_snap_m")})


@query("f20_json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS forward FROM events")
def json_access(t: Tables):
    parsed = F.from_json("props", "k bigint, forward boolean, distance_along_edge double")
    return t.raw("events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.coalesce("p.forward", F.lit(True)).alias("forward"))


@query("m03_quality_gate", with_tables("""WITH q AS (SELECT trace_id, count(*) AS n, 1 - count(*) FILTER (WHERE type = 'unmatched' OR trace_id % 7 = 0 AND type <> 'interpolated') / CAST(count(*) AS DOUBLE) AS quality FROM matched_points GROUP BY 1),
    e AS (SELECT trace_id, count(*) AS n FROM trace_edges WHERE trace_id % 11 > 0 GROUP BY 1)
    SELECT q.trace_id, CASE WHEN q.n < 2 THEN 'too_few_points' WHEN quality < 0.6 THEN 'poor_match' WHEN coalesce(e.n, 0) < 5 THEN 'too_few_edges' END AS dropped_because FROM q LEFT JOIN e USING (trace_id)""",
    "matched_points", "trace_edges"))
def quality_gate(t: Tables):
    worse = t.matched_points.withColumn("type", F.expr("CASE WHEN trace_id % 7 = 0 AND type <> 'interpolated' THEN 'unmatched' ELSE type END"))
    quality = ops.match_metrics(worse, KEYS)
    edges = t.trace_edges.where("trace_id % 11 > 0").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return ops.quality_gate(quality, quality.selectExpr("trace_id", "points AS n_points"), quality.select("trace_id", "quality"), edges, KEYS)


def raw_sessions(t: Tables):
    return t.trace_points.groupBy("trace_id", "line_id").agg(F.min("ts").alias("started_at")).selectExpr(
        "trace_id AS session_id", "line_id", "CASE WHEN trace_id % 9 = 0 THEN 'abandoned' ELSE 'completed' END AS status", "'raw' AS processing_status")


def trips_of(t: Tables):
    matched = t.matched_points.where("trace_id % 8 > 0").withColumnRenamed("trace_id", "session_id").drop("line_id")
    return ops.build_trips(raw_sessions(t), matched, t.trace_edges.withColumnRenamed("trace_id", "session_id").drop("line_id"))


@query("m04_trip_build", with_tables("""WITH s AS (SELECT trace_id, line_id, count(*) AS points, count(*) FILTER (WHERE type = 'matched') / CAST(count(*) AS DOUBLE) AS score FROM matched_points GROUP BY 1, 2)
    SELECT trace_id AS session_id, line_id, round(score, 6) AS match_score FROM s WHERE trace_id % 9 > 0 AND trace_id % 8 > 0""", "matched_points"))
def trip_build(t: Tables):
    return trips_of(t)["trips"].select("session_id", "line_id", F.round("match_score", 6).alias("match_score"))


@query("m04_build_outcomes", with_tables("""SELECT CASE WHEN trace_id % 9 = 0 THEN 'skipped' WHEN trace_id % 8 > 0 THEN 'matched' ELSE 'failed' END AS outcome, count(*) AS sessions
    FROM (SELECT DISTINCT trace_id FROM trace_points) GROUP BY 1""", "trace_points"))
def build_outcomes(t: Tables):
    return trips_of(t)["stats"]


@query("m05_nearest_road_edge", with_tables(f"""WITH pt AS (SELECT trace_id, point_index, radians(lon) * 6378137.0 AS px, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS py, cos(radians(lat)) AS shrink FROM trace_points),
    rd AS (SELECT DISTINCT edge_id, x1, y1, x2, y2 FROM (SELECT e.edge_id, s.x1, s.y1, s.x2, s.y2 FROM edge_segments s JOIN route_edges e USING (route_edge_id)))
    SELECT trace_id, point_index, round(min(d), 3) AS snap_m FROM (SELECT p.trace_id, p.point_index, {point_seg('p.px', 'p.py', 'r.x1', 'r.y1', 'r.x2', 'r.y2')} * p.shrink AS d FROM pt p JOIN rd r
      ON r.x1 <= p.px + 300 AND r.x2 >= p.px - 300) WHERE d <= 60 GROUP BY 1, 2""", "edge_segments"))
def nearest_road_edge(t: Tables):
    roads = t.route_edges.select("edge_id", "lon1", "lat1", "lon2", "lat2").distinct()
    out = ops.nearest_road_edges(t.trace_points, roads, KEYS)
    return out.where("type = 'matched'").select("trace_id", "point_index", F.round("snap_m", 3).alias("snap_m"))


@query("m06_despike_edge_shapes", with_tables("""WITH sh AS (SELECT trace_id, seq, v.vertex, CAST(-66.20 AS DOUBLE) + CAST(0.00094 AS DOUBLE) * seq + v.dx AS lon, CAST(-17.39 AS DOUBLE) + CAST(0.0027 AS DOUBLE) * (trace_id % 3) + v.dy AS lat
      FROM trace_edges, (VALUES (0, 0.0, 0.0), (1, 0.0001, 0.0009), (2, 0.0, 0.0)) AS v(vertex, dx, dy)),
    ref AS (SELECT trace_id, cos(radians(min(lat))) * 111320.0 AS k, count(*) AS n FROM trace_points GROUP BY 1),
    near AS (SELECT s.trace_id, s.seq, s.vertex, bool_or(sqrt(pow((s.lon - p.lon) * r.k, 2) + pow((s.lat - p.lat) * 110540.0, 2)) <= 30) AS ok
      FROM sh s JOIN ref r USING (trace_id) JOIN trace_points p ON p.trace_id = s.trace_id GROUP BY 1, 2, 3),
    cnt AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY trace_id, seq) AS c FROM near)
    SELECT c.trace_id, c.seq, c.vertex FROM cnt c JOIN ref USING (trace_id) WHERE ok OR c.c < 2 OR n < 2""", "trace_points", "trace_edges"))
def despike_edge_shapes(t: Tables):
    spikes = F.expr("""array(named_struct('vertex', 0L, 'dx', 0D, 'dy', 0D), named_struct('vertex', 1L, 'dx', 0.0001D, 'dy', 0.0009D), named_struct('vertex', 2L, 'dx', 0D, 'dy', 0D))""")
    shapes = t.trace_edges.select("trace_id", "seq", F.explode(spikes).alias("v")).selectExpr(
        "trace_id", "seq", "v.vertex", "cast(-66.20 AS double) + cast(0.00094 AS double) * seq + v.dx AS lon",
        "cast(-17.39 AS double) + cast(0.0027 AS double) * (trace_id % 3) + v.dy AS lat")
    return ops.despike_edge_shapes(shapes, t.trace_points, KEYS).select("trace_id", "seq", "vertex")


@query("m07_refine_corners")
def refine_corners(t: Tables):
    edges = t.trace_edges.withColumn("path", F.expr("""array(named_struct('lon', cast(-66.20 AS double) + 0.00094D * seq, 'lat', -17.39D),
        named_struct('lon', cast(-66.20 AS double) + 0.00094D * (seq + 1), 'lat', -17.39D))"""))
    points = t.trace_points.selectExpr("trace_id", "point_index AS seq", "explode(array(0.2D, 0.5D, 0.8D)) AS along", "lon", "lat", "event_id").selectExpr(
        "trace_id", "seq", "along", "lon + 0.00094D * along AS lon", "CASE WHEN event_id % 4 = 0 AND along = 0.5 THEN lat + 0.0004D ELSE lat END AS lat")
    return ops.refine_corners(edges, points, KEYS).groupBy("trace_id").agg(F.sum(F.size("path")).alias("vertices"))


@query("m15_despike_routes", with_tables("SELECT route_id, count(*) + 1 AS vertices, count(*) FILTER (WHERE sequence % 9 = 4) AS points_removed FROM route_edges GROUP BY 1", "route_edges"))
def despike_routes(t: Tables):
    """Routes with a planted stub that runs 20 m back at every ninth edge."""
    base = t.route_edges.selectExpr("route_id", "sequence", """CASE WHEN sequence % 9 = 4 THEN array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon1 - 0.0002D, 'lat', lat1))
        ELSE array(named_struct('lon', lon1, 'lat', lat1)) END AS pts""")
    ends = t.route_edges.groupBy("route_id").agg(F.max_by(F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")), "sequence").alias("e"))
    path = base.groupBy("route_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "pts"))), lambda s: s["pts"])).alias("p")).join(
        ends, "route_id").select("route_id", F.concat("p", F.array("e")).alias("path"))
    return ops.despike_routes(path).select("route_id", F.size("path").alias("vertices"), "points_removed")


def trip_ends(t: Tables):
    flip = F.col("trace_id") % 4 == 0
    ends = t.trace_points.groupBy("line_id", F.col("trace_id").alias("trip_id")).agg(
        F.min_by(F.struct("lon", "lat"), "point_index").alias("a"), F.max_by(F.struct("lon", "lat"), "point_index").alias("b"))
    turn = F.col("trip_id") % 4 == 0
    pick = lambda x, y, f: F.when(turn, F.col(f"{y}.{f}")).otherwise(F.col(f"{x}.{f}"))
    return ends.select("line_id", "trip_id", pick("a", "b", "lon").alias("first_lon"), pick("a", "b", "lat").alias("first_lat"),
                       pick("b", "a", "lon").alias("last_lon"), pick("b", "a", "lat").alias("last_lat"))


@query("m16_trip_directions", with_tables("""WITH e0 AS (SELECT line_id, trace_id AS trip_id, min_by(lon, point_index) AS alon, min_by(lat, point_index) AS alat, max_by(lon, point_index) AS blon, max_by(lat, point_index) AS blat FROM trace_points GROUP BY 1, 2),
    e AS (SELECT line_id, trip_id, CASE WHEN trip_id % 4 = 0 THEN -1 ELSE 1 END * (blon - alon) * 111320.0 * cos(radians((alat + blat) / 2)) AS e, CASE WHEN trip_id % 4 = 0 THEN -1 ELSE 1 END * (blat - alat) * 111320.0 AS n FROM e0),
    u AS (SELECT line_id, trip_id, e / sqrt(e*e + n*n) AS ue, n / sqrt(e*e + n*n) AS un FROM e WHERE sqrt(e*e + n*n) >= 50),
    r AS (SELECT line_id, min_by(ue, trip_id) AS re, min_by(un, trip_id) AS rn FROM u GROUP BY 1),
    s AS (SELECT u.*, CASE WHEN ue * re + un * rn >= 0 THEN 1 ELSE -1 END AS s FROM u JOIN r USING (line_id)),
    c AS (SELECT line_id, CASE WHEN count(*) FILTER (WHERE s > 0) < count(*) FILTER (WHERE s < 0) THEN -1 ELSE 1 END AS f, avg(ue * s) AS me, avg(un * s) AS mn FROM s GROUP BY 1)
    SELECT e.line_id, e.trip_id, round(ue * me * f / sqrt(me*me + mn*mn) + un * mn * f / sqrt(me*me + mn*mn), 4) AS dot,
      CASE WHEN u.ue IS NULL THEN 'unknown' WHEN round(ue * me * f / sqrt(me*me + mn*mn) + un * mn * f / sqrt(me*me + mn*mn), 4) >= -0.1 THEN 'forward' ELSE 'reverse' END AS direction
    FROM e LEFT JOIN u USING (line_id, trip_id) LEFT JOIN c ON c.line_id = e.line_id""", "trace_points"))
def trip_directions(t: Tables):
    return ops.trip_directions(trip_ends(t))


def end_requests(t: Tables):
    return t.raw("events").selectExpr(
        "event_id AS session_id", "CASE event_id % 4 WHEN 0 THEN event_id % 2500 END AS line_id", "CASE WHEN event_id % 4 = 1 THEN concat(' Nueva ', event_id % 9, ' ') WHEN event_id % 4 = 2 THEN '  ' END AS line_name",
        "'micro' AS line_type", "event_id % 6 = 0 AS is_detour", "'roadworks' AS reason", "ts AS at")


def ended(t: Tables):
    counts = t.trace_points.groupBy(F.col("trace_id").alias("session_id")).agg(F.count(F.lit(1)).alias("point_count"))
    lines = t.lines.withColumn("status", F.expr("CASE WHEN line_id % 10 = 0 THEN 'merged' ELSE status END"))
    return ops.end_sessions(t.sessions, end_requests(t), lines, counts)


ENDED = """req AS (SELECT event_id AS session_id, CASE event_id % 4 WHEN 0 THEN event_id % 2500 END AS want, CASE WHEN event_id % 4 = 1 THEN 'Nueva ' || (event_id % 9) END AS nm FROM events),
    a AS (SELECT r.*, s.status, CASE WHEN s.status IS NULL THEN 'unknown_session' WHEN s.status <> 'in_progress' THEN 'not_in_progress' WHEN want IS NOT NULL AND l.line_id IS NULL THEN 'unknown_line'
      WHEN l.line_id % 10 = 0 THEN 'merged_line' END AS why FROM req r LEFT JOIN sessions s USING (session_id) LEFT JOIN lines l ON l.line_id = r.want)"""


@query("m17_end_sessions", with_tables(f"""WITH {ENDED} SELECT s.session_id, CASE WHEN a.why IS NULL AND a.session_id IS NOT NULL THEN CASE WHEN a.want IS NOT NULL OR a.nm IS NOT NULL THEN 'completed' ELSE 'discarded' END ELSE s.status END AS status,
    CASE WHEN a.why IS NULL AND want IS NOT NULL THEN CAST(want AS VARCHAR) WHEN a.why IS NULL AND nm IS NOT NULL THEN 'draft-' || s.session_id ELSE CAST(s.line_id AS VARCHAR) END AS line_id
    FROM sessions s LEFT JOIN a USING (session_id)""", "sessions", "lines"))
def end_sessions(t: Tables):
    return ended(t)["sessions"].select("session_id", "status", "line_id")


@query("m17_end_rejects", with_tables(f"WITH {ENDED} SELECT session_id, why AS rejected_because FROM a WHERE why IS NOT NULL", "sessions", "lines"))
def end_rejects(t: Tables):
    return ended(t)["rejects"]


@query("w02_collapse_edges", with_tables(f"""WITH {COARSE} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS seq, edge_id FROM ce WHERE prev IS NULL OR prev <> edge_id""", "trace_edges"))
def collapse_edges(t: Tables):
    return ops.collapse_edges(coarse_edges(t), KEYS).select("trace_id", "seq", "edge_id")


@query("w03_weld_edge_shapes", with_tables(f"""WITH {COARSE}, r AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> edge_id THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS run FROM ce),
    w AS (SELECT trace_id, edge_id, run, count(*) + 1 AS n, min(seq) AS lo FROM r GROUP BY 1, 2, 3)
    SELECT trace_id, edge_id, max(n) AS vertices, max_by(lo, (n, -run)) AS first_seq FROM w GROUP BY 1, 2""", "trace_edges"))
def weld_edge_shapes(t: Tables):
    out = ops.weld_edge_shapes(shaped_edges(t), KEYS)
    return out.select("trace_id", "edge_id", F.size("path").alias("vertices"), F.element_at("path", 1)["lon"].cast("bigint").alias("first_seq"))


@query("w06_trace_arcs", with_tables(f"""SELECT trace_id, seq, edge_id, lead(edge_id) OVER (PARTITION BY trace_id ORDER BY seq) AS next_edge FROM trace_edges QUALIFY next_edge IS NOT NULL""", "trace_edges"))
def trace_arcs(t: Tables):
    return ordered.with_neighbours(t.trace_edges, KEYS, "seq", ["edge_id"], before=0).where("next1_edge_id IS NOT NULL").select(
        "trace_id", "seq", "edge_id", F.col("next1_edge_id").alias("next_edge"))
