"""Domain tables derived from the driver's tables.

The test data holds no GPS recordings, so every domain table is computed from
it by arithmetic both engines agree on. ``tables(spark, sf_dir)`` builds them
as DataFrames; ``SQL`` holds the same tables as DuckDB common table
expressions, used by ``oracle_sql`` as the independent check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colectivo.operators.ordered import number_rows
from colectivo.session import snapshot

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

LINE_NAMES = "element_at(array('Línea ', 'linea ', 'L. ', ''), cast(p_partkey % 4 as int) + 1)"


class Tables:
    """Lazily built domain tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS line_id",
            f"concat({LINE_NAMES}, cast(p_partkey % 50 as string)) AS name",
            "element_at(array('draft', 'pending', 'approved', 'approved'), cast(p_partkey % 4 as int) + 1) AS status",
            "element_at(array('micro', 'trufi', 'taxi_trufi'), cast(p_partkey % 3 as int) + 1) AS line_type",
            "cast(NULL AS bigint) AS merged_into_id",
            "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(p_partkey as int)) AS created_at",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        events = self.raw("events").selectExpr(
            "event_id AS session_id", "user_id AS device_id", "user_id % 5 AS line_id", "ts",
            "CASE event_type WHEN 'error' THEN 'abandoned' WHEN 'signup' THEN 'in_progress' ELSE 'completed' END AS status",
            "ts + make_dt_interval(0, 0, cast(event_id % 50 as int)) AS last_activity_at",
            "event_type = 'view' AS fresh", "date_trunc('DAY', ts) AS day",
        )
        done = number_rows(
            events.where("status = 'completed'"), ["line_id", "day"], ["ts", "session_id"], F.date_trunc("hour", "ts"), "rn"
        )
        timed = done.selectExpr(
            "session_id", "device_id", "line_id", "status", "fresh", "ts", "last_activity_at",
            "CASE WHEN line_id < 3 THEN day + make_dt_interval(0, 10, cast(8 * (rn % 90 + 1) + session_id % 3 as int)) ELSE ts END AS started_at",
        )
        other = events.where("status <> 'completed'").selectExpr(
            "session_id", "device_id", "line_id", "status", "fresh", "ts", "last_activity_at", "ts AS started_at"
        )
        return timed.unionByName(other).selectExpr(
            "session_id", "device_id", "line_id", "status",
            "CASE WHEN fresh THEN 'raw' ELSE 'processed' END AS processing_status",
            "started_at", "last_activity_at",
            "CASE WHEN status = 'completed' THEN last_activity_at END AS ended_at",
        )

    @cached_property
    def trips(self) -> DataFrame:
        """One cleaned trip per completed session that was processed."""
        return self.sessions.where("status = 'completed' AND processing_status = 'processed'").selectExpr(
            "session_id AS trip_id", "session_id", "device_id", "line_id",
            "CASE WHEN session_id % 7 = 0 THEN 'deviated' ELSE 'clean' END AS status",
            "(session_id % 101) / 100D AS match_score", "started_at",
        )

    @cached_property
    def trace_points(self) -> DataFrame:
        # Most queries read the points several times; they are numbered once.
        numbered = snapshot(number_rows(
            self.raw("events").select("event_id", "user_id", "ts"),
            ["user_id"], ["ts", "event_id"], F.to_date("ts"), "point_index",
        ))
        return numbered.selectExpr(
            "user_id AS trace_id", "user_id % 5 AS line_id", "point_index", "event_id",
            "cast(-66.20 AS double) + cast(0.00094 AS double) * point_index"
            " + cast(0.00001 AS double) * (event_id % 7 - 3) AS lon",
            "cast(-17.39 AS double) + cast(0.0027 AS double) * (user_id % 3)"
            " + cast(0.00001 AS double) * (event_id % 5 - 2) AS lat",
            "cast(5 + event_id % 20 AS double) AS accuracy", "ts",
        )

    @cached_property
    def trace_edges(self) -> DataFrame:
        return self.trace_points.selectExpr(
            "trace_id", "line_id", "point_index AS seq",
            "CASE WHEN event_id % 29 = 0 THEN 500000 + event_id ELSE point_index + 1000 * (trace_id % 3) END AS edge_id",
            "true AS forward",
        )

    @cached_property
    def matched_points(self) -> DataFrame:
        """Trace points as a matcher would return them; some are unmatched, some jump."""
        return self.trace_points.selectExpr(
            "trace_id", "line_id", "point_index",
            "lon", "CASE WHEN event_id % 31 = 0 THEN lat + cast(0.0006 AS double) ELSE lat END AS lat",
            "CASE event_id % 10 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'interpolated' ELSE 'matched' END AS type",
            "CASE WHEN event_id % 31 = 0 THEN 60.0D ELSE cast(event_id % 13 AS double) END AS snap_m",
            "accuracy", "ts", "event_id",
        )

    @cached_property
    def edge_geometry(self) -> DataFrame:
        """Two-vertex shape per road edge: edge k joins lattice node k to node k+1."""
        return self.trace_edges.groupBy("edge_id").agg(
            F.min("seq").alias("k"), F.min(F.col("trace_id") % 3).alias("lane")
        ).selectExpr(
            "edge_id",
            "cast(-66.20 AS double) + cast(0.00094 AS double) * k AS lon1",
            "cast(-17.39 AS double) + cast(0.0027 AS double) * lane AS lat1",
            "cast(-66.20 AS double) + cast(0.00094 AS double) * (k + 1) AS lon2",
            "cast(-17.39 AS double) + cast(0.0027 AS double) * lane AS lat2",
        )

    @cached_property
    def edge_shapes(self) -> DataFrame:
        """Shape of every road edge as ridden by each trace."""
        return self.trace_edges.join(self.edge_geometry, "edge_id").selectExpr(
            "line_id", "trace_id", "edge_id", "forward",
            "array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon2, 'lat', lat2)) AS path",
        ).distinct()

    @cached_property
    def route_paths(self) -> DataFrame:
        """Path of every live route; a route is bounded by its road edges."""
        return self.route_edges.groupBy("route_id", "line_id", "lane").agg(
            F.sort_array(F.collect_list(F.struct("sequence", "lon1", "lat1", "lon2", "lat2"))).alias("e")
        ).selectExpr(
            "route_id", "line_id", "lane",
            "concat(array(named_struct('lon', e[0].lon1, 'lat', e[0].lat1)),"
            " transform(e, x -> named_struct('lon', x.lon2, 'lat', x.lat2))) AS path",
        )

    @cached_property
    def route_edges(self) -> DataFrame:
        """One active route per line and lane, made of the lattice edges ridden there."""
        return self.trace_points.groupBy("line_id", F.expr("trace_id % 3 AS lane"), "point_index").agg(
            F.count(F.lit(1)).alias("riders")
        ).selectExpr(
            "line_id * 10 + lane AS route_id", "line_id", "lane", "point_index AS sequence",
            "point_index + 1000 * lane AS edge_id", "true AS forward", "riders",
            "(line_id * 10 + lane) * 1000000 + point_index AS route_edge_id",
            "cast(-66.20 AS double) + cast(0.00094 AS double) * point_index AS lon1",
            "cast(-17.39 AS double) + cast(0.0027 AS double) * lane AS lat1",
            "cast(-66.20 AS double) + cast(0.00094 AS double) * (point_index + 1) AS lon2",
            "cast(-17.39 AS double) + cast(0.0027 AS double) * lane AS lat2",
        )

    @cached_property
    def routes(self) -> DataFrame:
        """Route versions: every route of ``route_edges`` with an older superseded one before it."""
        active = self.route_edges.groupBy("route_id", "line_id", "lane").agg(
            F.max("riders").alias("trip_count"), F.count(F.lit(1)).alias("edge_count")
        ).selectExpr(
            "route_id", "line_id",
            "CASE lane WHEN 0 THEN 'main' WHEN 1 THEN 'r2' ELSE 'r3' END AS ramal_label",
            "2 AS version", "CASE WHEN lane = 1 THEN 'pending' ELSE 'confirmed' END AS status",
            "trip_count", "edge_count", "CASE WHEN lane = 2 THEN 2 ELSE 1 END AS fragment_count",
            "'overlap_assembly' AS strategy_key", "concat('Street ', lane) AS street_summary",
        )
        old = active.selectExpr(
            "route_id + 1000 AS route_id", "line_id", "ramal_label", "1 AS version", "'superseded' AS status",
            "trip_count", "edge_count", "fragment_count", "strategy_key", "street_summary",
        )
        return active.union(old)

    @cached_property
    def zones(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "cast(n_nationkey AS bigint) AS zone_id", "n_name AS name",
            "cast(-66.20 AS double) + cast(0.02 AS double) * (n_nationkey % 5) AS min_lon",
            "cast(-17.40 AS double) + cast(0.02 AS double) * (n_nationkey div 5) AS min_lat",
        ).selectExpr(
            "zone_id", "name",
            "array(array(named_struct('lon', min_lon, 'lat', min_lat), named_struct('lon', min_lon + 0.02D, 'lat', min_lat),"
            " named_struct('lon', min_lon + 0.02D, 'lat', min_lat + 0.02D), named_struct('lon', min_lon, 'lat', min_lat + 0.02D),"
            " named_struct('lon', min_lon, 'lat', min_lat))) AS rings",
        )

    @cached_property
    def fare_reports(self) -> DataFrame:
        items = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, date_format(l_shipdate, 'yyyyMMdd')) AS report_id",
            "l_partkey % 50 AS line_id", "o_custkey AS device_id",
            "cast(1 + (l_linenumber % 7) * 0.5 AS decimal(6,2)) AS amount",
            "cast(-66.20 AS double) + cast(0.001 AS double) * (l_suppkey % 100) AS boarding_lon",
            "cast(-17.40 AS double) + cast(0.001 AS double) * (l_partkey % 100) AS boarding_lat",
            "cast(-66.20 AS double) + cast(0.001 AS double) * (o_custkey % 100) AS alighting_lon",
            "cast(-17.40 AS double) + cast(0.001 AS double) * (o_custkey % 97) AS alighting_lat",
            "l_shipdate AS created_at",
        )

    @cached_property
    def edge_vote_events(self) -> DataFrame:
        items = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            "l_partkey % 200 AS edge_id", "o_custkey AS device_id",
            "CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'approve' END AS vote",
            "l_shipdate AS created_at", "l_orderkey", "l_linenumber", "l_partkey",
        )

    @cached_property
    def edge_votes(self) -> DataFrame:
        from colectivo.operators.votes import upsert_votes

        return upsert_votes(
            None, self.edge_vote_events, ["edge_id", "device_id"], ["created_at", "l_orderkey", "l_linenumber", "l_partkey"]
        ).select("edge_id", "device_id", "vote", "created_at")

    @cached_property
    def route_votes(self) -> DataFrame:
        """Each rider's votes on edges of the route it rides."""
        return self.trace_points.where("event_id % 3 = 0").selectExpr(
            "trace_id AS device_id", "(line_id * 10 + trace_id % 3) * 1000000 + point_index AS route_edge_id",
            "CASE WHEN event_id % 4 = 0 THEN 'reject' ELSE 'approve' END AS vote", "ts AS created_at",
        )

    @cached_property
    def line_vote_events(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey % 2000 AS line_id", "o_custkey AS device_id",
            "CASE WHEN o_orderstatus = 'F' THEN 'reject' ELSE 'approve' END AS vote", "o_orderdate AS created_at", "o_orderkey",
        )

    @cached_property
    def detours(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS detour_id", "o_custkey % 50 AS line_id", "o_orderdate AS last_confirmed_at",
            "1 + o_orderkey % 30 AS confirmed_count",
            "CASE WHEN o_orderstatus = 'F' THEN 'expired' ELSE 'active' END AS status",
        )

    @cached_property
    def detour_events(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id", "user_id AS device_id", "user_id % 5 AS line_id", "ts AS sent_at")

    @cached_property
    def descriptors(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id", "doc_id % 20 AS route_id", "text",
            "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int)) AS created_at",
            "doc_id % 17 AS device_id",
        )


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """DuckDB text of the haversine distance."""
    a = (
        f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def point_seg(px, py, ax, ay, bx, by) -> str:
    """DuckDB text of the distance from a point to a segment."""
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len_sq = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {len_sq} = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {len_sq})) END)"
    return f"sqrt(pow({px} - ({ax} + {t} * {dx}), 2) + pow({py} - ({ay} + {t} * {dy}), 2))"


def seg_seg(l: str, r: str) -> str:
    """DuckDB text of the distance between segments of two table aliases."""

    def side(p, q, s):
        (px, py), (qx, qy), (sx, sy) = p, q, s
        return f"(({qx} - {px}) * ({sy} - {py}) - ({qy} - {py}) * ({sx} - {px}))"

    a, b = (f"{l}.x1", f"{l}.y1"), (f"{l}.x2", f"{l}.y2")
    c, d = (f"{r}.x1", f"{r}.y1"), (f"{r}.x2", f"{r}.y2")
    crossing = f"({side(a, b, c)} * {side(a, b, d)} < 0 AND {side(c, d, a)} * {side(c, d, b)} < 0)"
    ends = ", ".join(
        [point_seg(*a, *c, *d), point_seg(*b, *c, *d), point_seg(*c, *a, *b), point_seg(*d, *a, *b)]
    )
    return f"(CASE WHEN {crossing} THEN 0.0 ELSE least({ends}) END)"


# DuckDB texts of the domain tables, in dependency order.
SQL = {
    "lines": """SELECT p_partkey AS line_id,
        (CASE p_partkey % 4 WHEN 0 THEN 'Línea ' WHEN 1 THEN 'linea ' WHEN 2 THEN 'L. ' ELSE '' END) || CAST(p_partkey % 50 AS VARCHAR) AS name,
        CASE p_partkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'pending' ELSE 'approved' END AS status,
        CASE p_partkey % 3 WHEN 0 THEN 'micro' WHEN 1 THEN 'trufi' ELSE 'taxi_trufi' END AS line_type,
        TIMESTAMP '2024-01-01' + to_minutes(p_partkey) AS created_at FROM part""",
    "sessions": """SELECT session_id, device_id, line_id, status,
        CASE WHEN fresh THEN 'raw' ELSE 'processed' END AS processing_status,
        CASE WHEN status = 'completed' AND line_id < 3 THEN day + to_hours(10) + to_minutes(8 * ((rn - 1) % 90 + 1) + session_id % 3) ELSE ts END AS started_at,
        last_activity_at, CASE WHEN status = 'completed' THEN last_activity_at END AS ended_at
        FROM (SELECT *, row_number() OVER (PARTITION BY line_id, day, status ORDER BY ts, session_id) AS rn FROM (
          SELECT event_id AS session_id, user_id AS device_id, user_id % 5 AS line_id, ts,
            CASE event_type WHEN 'error' THEN 'abandoned' WHEN 'signup' THEN 'in_progress' ELSE 'completed' END AS status,
            ts + to_minutes(event_id % 50) AS last_activity_at, event_type = 'view' AS fresh, date_trunc('day', ts) AS day FROM events))""",
    "trips": """SELECT session_id AS trip_id, session_id, device_id, line_id,
        CASE WHEN session_id % 7 = 0 THEN 'deviated' ELSE 'clean' END AS status, (session_id % 101) / 100.0 AS match_score, started_at
        FROM sessions WHERE status = 'completed' AND processing_status = 'processed'""",
    "trace_points": """SELECT trace_id, trace_id % 5 AS line_id, point_index, event_id,
        CAST(-66.20 AS DOUBLE) + CAST(0.00094 AS DOUBLE) * point_index + CAST(0.00001 AS DOUBLE) * (event_id % 7 - 3) AS lon,
        CAST(-17.39 AS DOUBLE) + CAST(0.0027 AS DOUBLE) * (trace_id % 3) + CAST(0.00001 AS DOUBLE) * (event_id % 5 - 2) AS lat,
        CAST(5 + event_id % 20 AS DOUBLE) AS accuracy, ts
        FROM (SELECT user_id AS trace_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS point_index FROM events)""",
    "trace_edges": """SELECT trace_id, line_id, point_index AS seq,
        CASE WHEN event_id % 29 = 0 THEN 500000 + event_id ELSE point_index + 1000 * (trace_id % 3) END AS edge_id, true AS forward FROM trace_points""",
    "matched_points": """SELECT trace_id, line_id, point_index, lon, CASE WHEN event_id % 31 = 0 THEN lat + CAST(0.0006 AS DOUBLE) ELSE lat END AS lat,
        CASE event_id % 10 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'interpolated' ELSE 'matched' END AS type,
        CASE WHEN event_id % 31 = 0 THEN 60.0 ELSE CAST(event_id % 13 AS DOUBLE) END AS snap_m, accuracy, ts, event_id FROM trace_points""",
    "edge_geometry": """SELECT edge_id, CAST(-66.20 AS DOUBLE) + CAST(0.00094 AS DOUBLE) * k AS lon1,
        CAST(-17.39 AS DOUBLE) + CAST(0.0027 AS DOUBLE) * lane AS lat1, CAST(-66.20 AS DOUBLE) + CAST(0.00094 AS DOUBLE) * (k + 1) AS lon2,
        CAST(-17.39 AS DOUBLE) + CAST(0.0027 AS DOUBLE) * lane AS lat2
        FROM (SELECT edge_id, min(seq) AS k, min(trace_id % 3) AS lane FROM trace_edges GROUP BY 1)""",
    "route_edges": """SELECT line_id * 10 + lane AS route_id, line_id, lane, point_index AS sequence, point_index + 1000 * lane AS edge_id,
        true AS forward, riders, (line_id * 10 + lane) * 1000000 + point_index AS route_edge_id,
        CAST(-66.20 AS DOUBLE) + CAST(0.00094 AS DOUBLE) * point_index AS lon1, CAST(-17.39 AS DOUBLE) + CAST(0.0027 AS DOUBLE) * lane AS lat1,
        CAST(-66.20 AS DOUBLE) + CAST(0.00094 AS DOUBLE) * (point_index + 1) AS lon2, CAST(-17.39 AS DOUBLE) + CAST(0.0027 AS DOUBLE) * lane AS lat2
        FROM (SELECT line_id, trace_id % 3 AS lane, point_index, count(*) AS riders FROM trace_points GROUP BY 1, 2, 3)""",
    "routes": """SELECT route_id + 1000 * old AS route_id, line_id, CASE lane WHEN 0 THEN 'main' WHEN 1 THEN 'r2' ELSE 'r3' END AS ramal_label,
        2 - old AS version, CASE WHEN old = 1 THEN 'superseded' WHEN lane = 1 THEN 'pending' ELSE 'confirmed' END AS status,
        trip_count, edge_count, CASE WHEN lane = 2 THEN 2 ELSE 1 END AS fragment_count, 'overlap_assembly' AS strategy_key,
        'Street ' || CAST(lane AS VARCHAR) AS street_summary
        FROM (SELECT route_id, line_id, lane, max(riders) AS trip_count, count(*) AS edge_count FROM route_edges GROUP BY 1, 2, 3),
        (VALUES (0), (1)) AS v(old)""",
    "zones": """SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS name,
        CAST(-66.20 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (n_nationkey % 5) AS min_lon,
        CAST(-17.40 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (n_nationkey // 5) AS min_lat FROM nation""",
    "fare_reports": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-'
          || strftime(l_shipdate, '%Y%m%d') AS report_id, l_partkey % 50 AS line_id, o_custkey AS device_id,
        CAST(1 + (l_linenumber % 7) * 0.5 AS DECIMAL(6,2)) AS amount,
        CAST(-66.20 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (l_suppkey % 100) AS boarding_lon,
        CAST(-17.40 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (l_partkey % 100) AS boarding_lat,
        CAST(-66.20 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (o_custkey % 100) AS alighting_lon,
        CAST(-17.40 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (o_custkey % 97) AS alighting_lat, l_shipdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "zoned_reports": """SELECT r.*,
        (SELECT min(zone_id) FROM zones z WHERE boarding_lon > z.min_lon AND boarding_lon < z.min_lon + 0.02 AND boarding_lat > z.min_lat AND boarding_lat < z.min_lat + 0.02) AS boarding_zone_id,
        (SELECT min(zone_id) FROM zones z WHERE alighting_lon > z.min_lon AND alighting_lon < z.min_lon + 0.02 AND alighting_lat > z.min_lat AND alighting_lat < z.min_lat + 0.02) AS alighting_zone_id
        FROM fare_reports r""",
    "edge_vote_events": """SELECT l_partkey % 200 AS edge_id, o_custkey AS device_id,
        CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'approve' END AS vote, l_shipdate AS created_at, l_orderkey, l_linenumber, l_partkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "edge_votes": """SELECT edge_id, device_id, vote, created_at FROM edge_vote_events
        QUALIFY row_number() OVER (PARTITION BY edge_id, device_id ORDER BY created_at DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1""",
    "route_votes": """SELECT trace_id AS device_id, (line_id * 10 + trace_id % 3) * 1000000 + point_index AS route_edge_id,
        CASE WHEN event_id % 4 = 0 THEN 'reject' ELSE 'approve' END AS vote, ts AS created_at FROM trace_points WHERE event_id % 3 = 0""",
    "line_vote_events": """SELECT o_orderkey % 2000 AS line_id, o_custkey AS device_id,
        CASE WHEN o_orderstatus = 'F' THEN 'reject' ELSE 'approve' END AS vote, o_orderdate AS created_at, o_orderkey FROM orders""",
    "line_votes": """SELECT line_id, device_id, vote, created_at FROM line_vote_events
        QUALIFY row_number() OVER (PARTITION BY line_id, device_id ORDER BY created_at DESC, o_orderkey DESC) = 1""",
    "trip_segments": """SELECT trace_id, line_id, point_index AS seg, radians(lon) * 6378137.0 AS x1, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS y1,
        radians(nlon) * 6378137.0 AS x2, ln(tan(pi() / 4 + radians(nlat) / 2)) * 6378137.0 AS y2
        FROM (SELECT *, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY point_index))
        WHERE nlon IS NOT NULL""",
    "edge_segments": """SELECT route_edge_id, route_id, line_id, sequence, radians(lon1) * 6378137.0 AS x1, ln(tan(pi() / 4 + radians(lat1) / 2)) * 6378137.0 AS y1,
        radians(lon2) * 6378137.0 AS x2, ln(tan(pi() / 4 + radians(lat2) / 2)) * 6378137.0 AS y2 FROM route_edges""",
    "detours": """SELECT o_orderkey AS detour_id, o_custkey % 50 AS line_id, o_orderdate AS last_confirmed_at,
        1 + o_orderkey % 30 AS confirmed_count, CASE WHEN o_orderstatus = 'F' THEN 'expired' ELSE 'active' END AS status FROM orders""",
    "detour_events": "SELECT event_id, user_id AS device_id, user_id % 5 AS line_id, ts AS sent_at FROM events",
    "descriptors": """SELECT doc_id, doc_id % 20 AS route_id, text,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, doc_id % 17 AS device_id FROM documents""",
}

NEEDS = {
    "matched_points": ["trace_points"], "trips": ["sessions"], "trace_edges": ["trace_points"], "edge_geometry": ["trace_edges"], "route_edges": ["trace_points"],
    "routes": ["route_edges"], "zoned_reports": ["fare_reports", "zones"], "edge_votes": ["edge_vote_events"],
    "route_votes": ["trace_points"], "line_votes": ["line_vote_events"], "trip_segments": ["trace_points"], "edge_segments": ["route_edges"],
}


def with_tables(body: str, *names: str) -> str:
    """Put the named domain tables, and what they rest on, before ``body`` as CTEs."""
    wanted: set[str] = set()

    def need(name):
        for other in NEEDS.get(name, []):
            need(other)
        wanted.add(name)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in SQL.items() if name in wanted)
    body = body.strip()
    if not wanted:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
