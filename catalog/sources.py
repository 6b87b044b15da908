"""Source and sink queries: what is written from the tables is read back and reported."""

import uuid

from pyspark.sql import functions as F

from catalog import query
from colectivo.functions import geo
from colectivo.plans import lifecycle
from colectivo.session import checkpoint_root, snapshot
from colectivo.sources import geojson, tables, tracks, zones
from fixtures import Tables, with_tables


def scratch(t: Tables, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/colectivo-{name}-{uuid.uuid4().hex}"


def route_documents(t: Tables):
    """One GeoJSON document per line: its lanes as features."""
    feature = F.struct(
        F.lit("Feature").alias("type"), F.create_map(F.lit("route_short_name"), F.concat(F.lit("L"), F.col("line_id").cast("string")), F.lit("lane"), F.col("lane").cast("string")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), F.transform("path", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"))
    docs = t.route_paths.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("lane", F.to_json(feature).alias("f")))).alias("l"))
    listed = F.array_join(F.transform("l", lambda s: s["f"]), ",")
    return docs.select("line_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("value"))


def written_routes(t: Tables) -> str:
    path = scratch(t, "routes")
    route_documents(t).repartition("line_id").write.partitionBy("line_id").text(path)
    return path


def read_lines(t: Tables):
    docs = geojson.read_documents(t.spark, written_routes(t))
    return snapshot(geojson.line_strings(geojson.features(docs)))


@query("s01_typed_tables", with_tables("SELECT session_id, line_id, status, match_score FROM trips", "trips"))
def typed_tables(t: Tables):
    root = scratch(t, "store")
    trips = t.trips.selectExpr("cast(trip_id AS string) AS trip_id", "cast(session_id AS string) AS session_id", "cast(line_id AS string) AS line_id", "status", "match_score")
    tables.write_table(trips, root, "trips")
    return tables.read_table(t.spark, root, "trips").selectExpr("cast(session_id AS bigint) AS session_id", "cast(line_id AS bigint) AS line_id", "status", "match_score")


@query("s01_quality_report", with_tables("SELECT 'enum:vote' AS check, count(*) FILTER (WHERE vote NOT IN ('approve', 'reject')) AS bad_rows FROM edge_vote_events UNION ALL SELECT 'unique:route_edge_id,device_id', count(*) - count(DISTINCT (edge_id, device_id)) FROM edge_vote_events", "edge_vote_events"))
def quality_report(t: Tables):
    return tables.quality_report(t.edge_vote_events.withColumnRenamed("edge_id", "route_edge_id"), "edge_votes")


@query("s02_read_geojson", with_tables("SELECT line_id, lane AS fragment_index, count(*) + 1 AS vertices FROM route_edges GROUP BY 1, 2", "route_edges"))
def read_geojson(t: Tables):
    rows = read_lines(t)
    return rows.select(F.substring(F.col("properties")["route_short_name"], 2, 9).cast("bigint").alias("line_id"), F.col("fragment_index").cast("bigint").alias("fragment_index"), F.size("path").alias("vertices"))


@query("s03_import_routes", with_tables("""SELECT CAST(line_id AS VARCHAR) AS line_id, version, 'superseded' AS status, count(*) AS n FROM routes WHERE line_id % 2 = 0 GROUP BY 1, 2
    UNION ALL SELECT CAST(line_id AS VARCHAR), version, status, count(*) FROM routes WHERE line_id % 2 = 1 GROUP BY 1, 2, 3
    UNION ALL SELECT CASE WHEN line_id % 2 = 0 THEN CAST(line_id AS VARCHAR) ELSE 'imported-L' || line_id END, CASE WHEN line_id % 2 = 0 THEN 3 ELSE 1 END, 'confirmed', count(DISTINCT lane) FROM route_edges GROUP BY 1, 2, 3""", "routes", "route_edges"))
def import_routes(t: Tables):
    """Files of all lines; those of even lines are known by name, the others are made."""
    lines = t.lines.withColumn("name", F.expr("concat(if(line_id % 2 = 0, 'L', 'M'), line_id)"))
    files = read_lines(t).select("file", F.col("properties")["route_short_name"].alias("line_name"), "fragment_index", "path")
    _, routes, _ = lifecycle.import_routes(files, lines, t.routes)
    return routes.groupBy("line_id", "version", "status").agg(F.count(F.lit(1)).alias("n"))


@query("s04_gtfs_shapes", with_tables("""WITH last AS (SELECT line_id, max(trace_id) AS trace_id FROM trace_points GROUP BY 1) SELECT CAST(line_id AS VARCHAR) AS route_id, CAST(l.trace_id AS VARCHAR) AS shape_id, count(*) AS points, round(max(lon), 6) AS max_lon
    FROM last l JOIN trace_points USING (line_id, trace_id) GROUP BY 1, 2""", "trace_points"))
def gtfs_shapes(t: Tables):
    root = scratch(t, "gtfs")
    csv = lambda df, name: df.write.option("header", True).csv(f"{root}/{name}.txt")
    csv(t.trace_points.select("line_id").distinct().selectExpr("line_id AS route_id", "concat('L', line_id) AS route_short_name", "'x' AS route_long_name"), "routes")
    csv(t.trace_points.select("line_id", "trace_id").distinct().orderBy("trace_id").coalesce(1).selectExpr("line_id AS route_id", "trace_id AS shape_id"), "trips")
    csv(t.trace_points.selectExpr("trace_id AS shape_id", "point_index AS shape_pt_sequence", "lon AS shape_pt_lon", "lat AS shape_pt_lat"), "shapes")
    routes, trips, shapes = geojson.read_gtfs(t.spark, root)
    return geojson.gtfs_route_points(routes, trips, shapes).groupBy("route_id", "shape_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.max("lon"), 6).alias("max_lon"))


@query("s05_write_geojson", with_tables("SELECT line_id, count(*) AS features FROM (SELECT DISTINCT line_id, lane FROM route_edges) GROUP BY 1", "route_edges"))
def write_geojson(t: Tables):
    routes = t.route_paths.select("line_id", F.lit(0).alias("direction_group"), F.col("lane").cast("string").alias("ramal_label"), "path", F.lit(3).alias("trace_count"))
    none = t.route_paths.limit(0).select("line_id", F.lit(0).alias("direction_group"), F.lit("").alias("ramal_label"), "path", F.lit(0.5).alias("confidence"), F.lit(None).cast(geo.PATH_TYPE).alias("bridge"))
    path = scratch(t, "features")
    geojson.write_features(geojson.route_features(routes, none), path)
    back = t.spark.read.text(path)
    return back.where("value LIKE '%LineString%'").groupBy(F.col("line_id").cast("bigint").alias("line_id")).agg(F.count(F.lit(1)).alias("features"))


@query("s06_sessions_from_tracks", with_tables("""SELECT trace_id AS session_id, 'simulator-' || trace_id AS device_id, strftime(min_by(ts, point_index), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max_by(ts, point_index), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS points, count(*) >= 2 AS has_path FROM trace_points GROUP BY 1""", "trace_points"))
def sessions_from_tracks(t: Tables):
    rows = t.trace_points.selectExpr("trace_id AS track_id", "point_index", "ts", "lon", "lat")
    s, _ = tracks.sessions_from_tracks(rows)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("session_id", "device_id", fmt("started_at"), fmt("ended_at"), "points", "has_path")


@query("s07_zones_from_elements", "SELECT n_name AS name, 1 AS rings, 5 AS vertices FROM nation")
def zones_from_elements(t: Tables):
    """Each zone's square as four ways in shuffled order and mixed direction."""
    box = t.zones.select("zone_id", "name", F.posexplode(F.slice(F.col("rings")[0], 1, 4)).alias("i", "p"))
    nodes = box.select((F.col("zone_id") * 10 + F.col("i")).alias("node_id"), "p.lon", "p.lat")
    ends = F.array(F.col("zone_id") * 10 + F.col("i"), F.col("zone_id") * 10 + (F.col("i") + 1) % 4)
    ways = box.select((F.col("zone_id") * 10 + (F.col("i") * 3 + 1) % 4).alias("way_id"), F.when(F.col("i") % 2 == 1, F.reverse(ends)).otherwise(ends).alias("node_ids"))
    relations = t.zones.select(F.col("zone_id").alias("relation_id"), "name", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(
        F.lit("way").alias("type"), (F.col("zone_id") * 10 + k).alias("ref"), F.when(k % 2 == 0, "outer").otherwise("").alias("role"))).alias("members"))
    out = zones.zones_from_elements(relations, zones.way_paths(nodes, ways))
    return out.select("name", F.size("rings").alias("rings"), F.size(F.col("rings")[0]).alias("vertices"))


@query("s07_zone_upsert", "SELECT count(*) FILTER (WHERE n_nationkey % 2 = 1) AS created, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS updated FROM nation")
def zone_upsert(t: Tables):
    return zones.upsert_zones(t.zones.where("zone_id % 2 = 0"), t.zones.select("name", "rings"))[1]


@query("s08_upload_acks", with_tables("""WITH b AS (SELECT p.*, s.status FROM trace_points p JOIN sessions s ON s.session_id = p.trace_id)
    SELECT trace_id AS session_id, count(*) AS added, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM b WHERE status = 'in_progress' GROUP BY 1""", "trace_points", "sessions"))
def upload_acks(t: Tables):
    batch = t.trace_points.selectExpr("trace_id AS session_id", "ts", "lon", "lat", "ts AS received_at")
    acks = tracks.accept_batch(batch, t.sessions)[2]
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return acks.select("session_id", "added", fmt("first_ts"), fmt("last_ts"))


@query("s08_upload_rejects", with_tables("""SELECT t.trace_id AS session_id, CASE WHEN s.status IS NULL THEN 'unknown_session' ELSE 'not_in_progress' END AS rejected_because FROM (SELECT DISTINCT trace_id FROM trace_points) t
    LEFT JOIN sessions s ON s.session_id = t.trace_id WHERE s.status IS NULL OR s.status <> 'in_progress'""", "trace_points", "sessions"))
def upload_rejects(t: Tables):
    batch = t.trace_points.selectExpr("trace_id AS session_id", "ts", "ts AS received_at")
    return tracks.accept_batch(batch, t.sessions)[3]


@query("s09_backfill_devices", with_tables("SELECT device_id FROM sessions UNION SELECT device_id FROM line_vote_events UNION SELECT c_custkey FROM customer", "sessions", "line_vote_events"))
def backfill_devices(t: Tables):
    from colectivo.operators.listings import device_ids

    known = t.raw("customer").selectExpr("c_custkey AS device_id")
    return tables.sync_devices(known, device_ids(t.sessions, t.line_vote_events)).select("device_id")


@query("s10_metrics_csv", with_tables("SELECT line_id, count(*) AS trips FROM trips GROUP BY 1", "trips"))
def metrics_csv(t: Tables):
    path = scratch(t, "metrics")
    geojson.write_metrics(t.trips.groupBy("line_id").agg(F.count(F.lit(1)).alias("trips")), path)
    return t.spark.read.option("header", True).schema("line_id bigint, trips bigint").csv(path)


@query("s11_trace_layer", with_tables("SELECT trace_id, line_id, 0 AS part, count(*) AS vertices FROM trace_points GROUP BY 1, 2 HAVING count(*) >= 2", "trace_points"))
def trace_layer(t: Tables):
    return geojson.trace_layer(t.trace_points, ["line_id", "trace_id"]).select("trace_id", "line_id", F.col("part").cast("bigint").alias("part"), "vertices")


@query("s11_fare_points", with_tables("""SELECT report_id, 'boarding' AS kind, round(boarding_lon, 6) AS lon, round(boarding_lat, 6) AS lat FROM fare_reports UNION ALL SELECT report_id, 'alighting', round(alighting_lon, 6), round(alighting_lat, 6) FROM fare_reports""", "fare_reports"))
def fare_points(t: Tables):
    return geojson.fare_point_layer(t.fare_reports).select("report_id", "kind", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s11_variant_layer", with_tables("SELECT r.line_id, r.route_id, ramal_label, status, count(*) + 1 AS vertices FROM routes r JOIN route_edges e USING (route_id) WHERE status <> 'superseded' GROUP BY ALL", "routes", "route_edges"))
def variant_layer(t: Tables):
    return geojson.variant_layer(t.routes, t.route_paths.select("route_id", "path")).select("line_id", "route_id", "ramal_label", "status", "vertices")


@query("s11_zone_layer", "SELECT n_name AS name, 5 AS kept FROM nation")
def zone_layer(t: Tables):
    """Zone rings simplified at 0.001°; a square keeps its corners."""
    from colectivo.operators.polyline import simplify

    ring = t.zones.select("name", F.posexplode(F.col("rings")[0]).alias("point_index", "p")).select("name", "point_index", "p.lon", "p.lat")
    return simplify(ring, ["name"], "point_index", 0.001).groupBy("name").agg(F.count(F.lit(1)).alias("kept"))


@query("s12_reconstruction_traces", with_tables("""WITH g AS (SELECT trace_id FROM trace_points WHERE trace_id % 7 > 0 GROUP BY 1 HAVING count(*) >= 2), ce AS (SELECT trace_id, edge_id // 3 AS e, lag(edge_id // 3) OVER (PARTITION BY trace_id ORDER BY seq) AS p FROM trace_edges)
    SELECT g.trace_id, (SELECT count(*) FROM trace_points p WHERE p.trace_id = g.trace_id) AS points, (SELECT count(*) FROM ce WHERE ce.trace_id = g.trace_id AND (p IS NULL OR p <> e)) AS edges FROM g""", "trace_points", "trace_edges"))
def reconstruction_traces(t: Tables):
    trips = t.trace_points.select("trace_id", "line_id").distinct().selectExpr("trace_id AS trip_id", "line_id", "CASE WHEN trace_id % 7 = 0 THEN 'deviated' ELSE 'clean' END AS status")
    edges = t.trace_edges.selectExpr("trace_id AS trip_id", "seq", "edge_id div 3 AS edge_id", "forward")
    traces, points, own = tracks.reconstruction_traces(trips, t.trace_points.selectExpr("trace_id AS trip_id", "ts", "lon", "lat"), edges)
    n = points.groupBy("trace_id").agg(F.count(F.lit(1)).alias("points"))
    e = own.groupBy("trace_id").agg(F.count(F.lit(1)).alias("edges"))
    return traces.select("trace_id").join(n, "trace_id").join(e, "trace_id")


@query("s13_primary_line", with_tables("SELECT line_id, max(n) + 1 AS vertices FROM (SELECT line_id, lane, count(*) AS n FROM route_edges GROUP BY 1, 2) GROUP BY 1", "route_edges"))
def primary_line(t: Tables):
    rows = read_lines(t).withColumn("name", F.col("properties")["route_short_name"])
    return geojson.primary_line(rows).select(F.substring("name", 2, 9).cast("bigint").alias("line_id"), F.size("path").alias("vertices"))


@query("f15_edge_shapes", with_tables("SELECT route_id, sequence, CASE WHEN sequence % 4 = 0 THEN 2 ELSE least(sequence + sequence % 4, last) - sequence + 1 END AS vertices FROM route_edges JOIN (SELECT route_id, count(*) AS last FROM route_edges GROUP BY 1) USING (route_id)", "route_edges"))
def edge_shapes(t: Tables):
    """Slices of route shapes: begin at the edge, zero to three vertices on, clamped at the route's end, reversed for odd ones."""
    from colectivo.operators.cleaning import edge_shape

    rows = t.route_edges.select("route_id", "sequence").join(t.route_paths.select("route_id", "path"), "route_id")
    begin, end = F.col("sequence").cast("int"), (F.col("sequence") + F.col("sequence") % 4).cast("int")
    odd = F.col("sequence") % 2 == 1
    cut = edge_shape(F.col("path"), F.when(odd, end).otherwise(begin), F.when(odd, begin).otherwise(end))
    return rows.select("route_id", "sequence", F.size(cut).cast("bigint").alias("vertices"))
