"""Transit graph and travel time queries."""

from pyspark.sql import functions as F

from catalog import query
from colectivo.functions import geo
from colectivo.operators import fares, schedules
from colectivo.plans import routing as ops
from colectivo.session import snapshot
from fixtures import Tables, hav, with_tables

NEED = ("lines", "routes", "route_edges")
TIMED = f"""timed AS (SELECT r.route_id, e.sequence, e.lon1, e.lat1, e.lon2, e.lat2, l.status = 'approved' AS line_approved, r.status = 'confirmed' AS route_confirmed, {hav('e.lon1', 'e.lat1', 'e.lon2', 'e.lat2')} AS m
    FROM routes r JOIN lines l ON l.line_id = r.line_id AND l.status IN ('approved', 'pending') JOIN route_edges e ON e.route_id = r.route_id WHERE r.status <> 'superseded')"""


def open_lines(t: Tables):
    """Every ridden line open to riders, so that the graph spans all five."""
    return t.lines.withColumn("status", F.expr("CASE WHEN line_id < 5 THEN 'approved' ELSE status END"))


def measured(t: Tables):
    return t.route_edges.withColumn("length_m", geo.haversine("lon1", "lat1", "lon2", "lat2"))


def graph(t: Tables, lines=None, confirmed: bool = False):
    routes = t.routes.withColumn("status", F.expr("CASE WHEN status = 'pending' THEN 'confirmed' ELSE status END")) if confirmed else t.routes
    timed = snapshot(ops.bus_edges(t.lines if lines is None else lines, routes, measured(t)))
    nodes, at = ops.merge_nodes(timed)
    return timed, snapshot(nodes), at


@query("n01_graph_nodes", with_tables(f"""WITH {TIMED} SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, count(DISTINCT line_id) AS lines FROM (
    SELECT lon1 AS lon, lat1 AS lat, e.line_id FROM route_edges e JOIN timed t ON t.route_id = e.route_id AND t.sequence = e.sequence
    UNION ALL SELECT e.lon2, e.lat2, e.line_id FROM route_edges e JOIN timed t ON t.route_id = e.route_id AND t.sequence = e.sequence) GROUP BY 1, 2""".replace("SELECT lon1 AS lon, lat1 AS lat, e.line_id", "SELECT e.lon1 AS lon, e.lat1 AS lat, e.line_id").replace(
        "SELECT round(lon, 6) AS lon", "SELECT round(lon, 6) AS lon"), *NEED))
def graph_nodes(t: Tables):
    _, nodes, _ = graph(t)
    return nodes.select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.size("lines").alias("lines"))


@query("n02_bus_edges", with_tables(f"WITH {TIMED} SELECT route_id, sequence, line_approved, route_confirmed, round(m / 4.17, 4) AS seconds FROM timed", *NEED))
def bus_edges(t: Tables):
    return ops.bus_edges(t.lines, t.routes, measured(t)).select("route_id", "sequence", "line_approved", "route_confirmed", F.round("seconds", 4).alias("seconds"))


@query("n03_gap_edges", with_tables(f"""WITH {TIMED}, k AS (SELECT * FROM timed WHERE sequence % 6 <> 5), g AS (SELECT route_id, sequence, lag(lon2) OVER w AS plon, lag(lat2) OVER w AS plat, lon1, lat1 FROM k WINDOW w AS (PARTITION BY route_id ORDER BY sequence))
    SELECT route_id, sequence, round({hav('plon', 'plat', 'lon1', 'lat1')}, 3) AS metres FROM g WHERE plon IS NOT NULL AND {hav('plon', 'plat', 'lon1', 'lat1')} > 20""", *NEED))
def gap_edges(t: Tables):
    timed = snapshot(ops.bus_edges(t.lines, t.routes, measured(t)).where("sequence % 6 <> 5"))
    _, at = ops.merge_nodes(timed)
    return ops.gap_edges(timed, at).select("route_id", "sequence", F.round("metres", 3).alias("metres"))


def stops_grid(t: Tables):
    """Nodes of suppliers on a street grid, each served by one or two lines."""
    return t.raw("supplier").selectExpr(
        "cast(s_suppkey AS string) AS node_id", "cast(-66.20 AS double) + cast(0.0031 AS double) * (s_suppkey % 40) AS lon", "cast(-17.40 AS double) + cast(0.0023 AS double) * (s_suppkey div 40) AS lat",
        "array_distinct(array(s_suppkey % 4, s_suppkey % 7)) AS lines")


GRID = """nd AS (SELECT CAST(s_suppkey AS VARCHAR) AS node_id, CAST(-66.20 AS DOUBLE) + CAST(0.0031 AS DOUBLE) * (s_suppkey % 40) AS lon, CAST(-17.40 AS DOUBLE) + CAST(0.0023 AS DOUBLE) * (s_suppkey // 40) AS lat,
    list_distinct([s_suppkey % 4, s_suppkey % 7]) AS lines FROM supplier)"""


@query("j11_transfer_edges", f"""WITH {GRID} SELECT a.node_id AS from_node, b.node_id AS to_node, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS metres FROM nd a, nd b
    WHERE a.node_id <> b.node_id AND NOT list_has_any(a.lines, b.lines) AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 400""")
def transfer_edges(t: Tables):
    return ops.transfer_edges(stops_grid(t)).select("from_node", "to_node", F.round("metres", 3).alias("metres"))


@query("j12_access_edges", f"""WITH {GRID}, pl AS (SELECT c_custkey AS place_id, CAST(-66.20 AS DOUBLE) + CAST(0.0007 AS DOUBLE) * (c_custkey % 180) AS lon, CAST(-17.40 AS DOUBLE) + CAST(0.0009 AS DOUBLE) * (c_custkey % 31) AS lat FROM customer)
    SELECT place_id, node_id, round({hav('p.lon', 'p.lat', 'n.lon', 'n.lat')}, 3) AS metres FROM pl p, nd n WHERE {hav('p.lon', 'p.lat', 'n.lon', 'n.lat')} <= 800""")
def access_edges(t: Tables):
    places = t.raw("customer").selectExpr("c_custkey AS place_id", "cast(-66.20 AS double) + cast(0.0007 AS double) * (c_custkey % 180) AS lon", "cast(-17.40 AS double) + cast(0.0009 AS double) * (c_custkey % 31) AS lat")
    return ops.access_edges(places, stops_grid(t)).select("place_id", "node_id", F.round("metres", 3).alias("metres"))


@query("n04_graph_stats", with_tables(f"""WITH {TIMED}, ends AS (SELECT DISTINCT round(e.lon1, 6) AS lon, round(e.lat1, 6) AS lat, e.line_id FROM route_edges e JOIN timed t ON t.route_id = e.route_id AND t.sequence = e.sequence
      UNION SELECT round(e.lon2, 6), round(e.lat2, 6), e.line_id FROM route_edges e JOIN timed t ON t.route_id = e.route_id AND t.sequence = e.sequence),
    nd AS (SELECT lon, lat, list(line_id) AS lines FROM ends GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM timed) AS bus_edges, (SELECT count(*) FROM nd a, nd b WHERE NOT list_has_any(a.lines, b.lines) AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 400) AS transfer_edges,
    (SELECT count(DISTINCT line_id) FROM ends) AS lines""", *NEED))
def graph_stats(t: Tables):
    timed, nodes, at = graph(t)
    return ops.graph_stats(nodes, timed, ops.gap_edges(timed, at), snapshot(ops.transfer_edges(nodes)))


def pairs(t: Tables):
    """Trips asked for: from customers' to suppliers' places."""
    return t.raw("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).selectExpr(
        "o_custkey AS od_id", "cast(-66.199 AS double) + cast(0.001 AS double) * (o_custkey % 20) AS olon", "cast(-17.391 AS double) + cast(0.0015 AS double) * (o_custkey % 5) AS olat",
        "cast(-66.17 AS double) + cast(0.001 AS double) * (k % 30) AS dlon", "cast(-17.391 AS double) + cast(0.0015 AS double) * (k % 5) AS dlat")


def travelled(t: Tables):
    timed, nodes, at = graph(t, open_lines(t), confirmed=True)
    stops = snapshot(ops.route_stops(timed, at))
    return nodes, ops.travel_times(pairs(t), nodes, stops, snapshot(ops.transfer_edges(nodes)))


@query("n05_travel_times")
def travel_times(t: Tables):
    _, (times, _) = travelled(t)
    return times.select("od_id", F.round("seconds", 2).alias("seconds"))


@query("w09_merged_legs", with_tables("""WITH l AS (SELECT trace_id AS od_id, point_index AS leg, CASE WHEN event_id % 5 = 0 THEN 'walk' ELSE 'bus' END AS mode, CASE WHEN event_id % 5 = 0 THEN NULL ELSE point_index // 4 END AS line_id, event_id % 10 AS metres FROM trace_points),
    r AS (SELECT *, sum(CASE WHEN mode = 'bus' AND pm = 'bus' AND line_id = pl THEN 0 ELSE 1 END) OVER (PARTITION BY od_id ORDER BY leg) AS run FROM (SELECT *, lag(mode) OVER w AS pm, lag(line_id) OVER w AS pl FROM l WINDOW w AS (PARTITION BY od_id ORDER BY leg)))
    SELECT od_id, CAST(run - 1 AS BIGINT) AS leg, mode, line_id, CAST(sum(metres) AS BIGINT) AS metres FROM r GROUP BY od_id, run, mode, line_id""", "trace_points"))
def merged_legs(t: Tables):
    legs = t.trace_points.selectExpr("trace_id AS od_id", "point_index AS leg", "CASE WHEN event_id % 5 = 0 THEN 'walk' ELSE 'bus' END AS mode", "CASE WHEN event_id % 5 > 0 THEN point_index div 4 END AS line_id",
        "event_id % 10 AS metres", "1D AS seconds", "'a' AS from_node", "'b' AS to_node")
    return ops.merge_legs(legs).select("od_id", F.col("leg").cast("bigint").alias("leg"), "mode", "line_id", "metres")


@query("n06_itineraries")
def itineraries(t: Tables):
    nodes, (_, legs) = travelled(t)
    legs = snapshot(legs)
    place = nodes.select("node_id", "lon", "lat")
    zone = lambda name: fares.resolve_zone(place, t.zones, "lon", "lat", name).select(F.col("node_id").alias(name.replace("zone", "node")), name)
    bus = legs.where("mode = 'bus'").join(zone("from_zone"), "from_node", "left").join(zone("to_zone"), "to_node", "left")
    # Only reports of ridden lines can price a leg, so only theirs are placed in zones.
    reports = t.fare_reports.join(snapshot(legs.where("mode = 'bus'").select("line_id").distinct()), "line_id", "left_semi")
    priced = fares.leg_fares(bus.select("od_id", "leg", "line_id", "from_zone", "to_zone"), t.lines, fares.resolve_report_zones(reports, t.zones)).select("od_id", "leg", "fare")
    moments = legs.where("line_id IS NOT NULL").select("line_id").distinct().withColumn("at", F.to_timestamp(F.lit("2024-01-10 15:00:00")))
    headway = schedules.current_headway(schedules.infer_schedules(open_lines(t), t.sessions), moments).select("line_id", "headway_min")
    _, totals = ops.itineraries(legs, priced, headway, t.detours, F.to_timestamp(F.lit("1998-06-01 00:00:00")))
    return totals.withColumns({"metres": F.round("metres", 1), "seconds": F.round("seconds", 1)})
