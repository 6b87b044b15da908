"""The nightly run over the platform's tables, twice."""

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.lifecycle import KEY
from colectivo.operators.votes import upsert_votes
from colectivo.plans import nightly
from colectivo.session import checkpoint_root, snapshot
from fixtures import Tables, hav, with_tables

NOW = "2024-02-01 00:00:00"
#: Lines of the traces; line 0 is a draft that the run merges into line 50.
LINE = "element_at(array(0, 2, 3, 6, 7), cast(trace_id % 5 as int) + 1)"
HOME = "element_at(array(50, 2, 3, 6, 7), cast(line_id as int) + 1)"


def platform(t: Tables) -> nightly.Tables:
    """Recordings of every trace, two live routes a line (the second one ending early) and their votes, reports and detours."""
    empty = lambda ddl: t.spark.createDataFrame([], ddl)
    mine = f"cast({LINE} AS bigint) AS line_id"
    sessions = t.trace_points.groupBy("trace_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).selectExpr(
        "trace_id AS session_id", "trace_id AS device_id", mine, "CASE WHEN trace_id % 10 = 7 THEN 'in_progress' ELSE 'completed' END AS status",
        "'raw' AS processing_status", "a AS started_at", "z AS last_activity_at", "CASE WHEN trace_id % 10 <> 7 THEN z END AS ended_at")
    kept = t.route_paths.where("lane < 2").selectExpr(
        f"cast({HOME} AS bigint) AS line_id", "lane", "CASE lane WHEN 0 THEN 'main' ELSE 'r2' END AS ramal_label",
        "CASE lane WHEN 0 THEN path ELSE slice(path, 1, cast(ceil(size(path) * 0.6) AS int)) END AS path",
    ).selectExpr("concat_ws('/', line_id, ramal_label, 'v1') AS route_id", "line_id", "lane", "ramal_label", "path")
    routes = kept.selectExpr(
        "route_id", "line_id", "ramal_label", "1 AS version", "CASE lane WHEN 0 THEN 'confirmed' ELSE 'pending' END AS status", "'consensus' AS strategy_key", "1 AS fragment_count",
        "cast(2 AS bigint) AS trip_count", "cast(NULL AS timestamp) AS last_compared_at", "'' AS street_summary", "cast(NULL AS bigint) AS first_zone_id", "cast(NULL AS bigint) AS last_zone_id", "path")
    cut = kept.selectExpr("route_id", "line_id", "lane", "ramal_label", "path", "explode(sequence(0, size(path) - 2)) AS k")
    edges = cut.selectExpr(
        "concat_ws('#', route_id, k) AS route_edge_id", "route_id", "line_id", "ramal_label", "cast(k AS bigint) AS sequence", "cast(k + 1000 * lane AS bigint) AS edge_id", "true AS forward",
        "slice(path, k + 1, 2) AS path", "'pending' AS status", "cast(NULL AS timestamp) AS confirmed_at")
    ballots = t.trace_points.where("event_id % 3 = 0 AND trace_id % 3 < 2").selectExpr(
        f"concat_ws('#', concat_ws('/', {HOME.replace('line_id', 'trace_id % 5')}, CASE trace_id % 3 WHEN 0 THEN 'main' ELSE 'r2' END, 'v1'), point_index) AS route_edge_id",
        "trace_id AS device_id", "CASE WHEN event_id % 4 = 0 THEN 'reject' ELSE 'approve' END AS vote", "ts AS created_at")
    none = {f"{end}_zone_id": F.lit(None).cast("bigint") for end in ("boarding", "alighting")}
    return {
        "lines": t.lines, "sessions": sessions, "detours": t.detours, "fare_reports": t.fare_reports.withColumns(none), "zones": t.zones.select("zone_id", "name", "rings"),
        "matched": t.matched_points.withColumnRenamed("trace_id", "session_id").drop("line_id", "event_id"),
        "trace_edges": t.trace_edges.withColumnRenamed("trace_id", "session_id").drop("line_id"),
        "roads": t.edge_geometry.selectExpr("edge_id", "array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon2, 'lat', lat2)) AS path", "concat('Calle ', cast(edge_id % 1000 AS bigint) div 10) AS street", "0.1D AS length_km"),
        "trips": empty("trip_id long, session_id long, line_id long, status string, match_score double, mean_snap_m double, path_points long"),
        "trip_points": empty("trip_id long, point_index long, lon double, lat double, ts timestamp"), "trip_edges": empty("trip_id long, seq long, edge_id long, forward boolean"),
        "routes": routes, "route_edges": edges.join(ballots.select("route_edge_id").distinct().withColumn("_", F.lit(1)), "route_edge_id", "left").drop("_"),
        "route_votes": ballots.join(edges.select("route_edge_id"), "route_edge_id", "left_semi"),
        "line_votes": upsert_votes(None, t.line_vote_events, ["line_id", "device_id"], ["created_at", "o_orderkey"]).select("line_id", "device_id", "vote", "created_at"),
        "schedules": empty("line_id long, day_bucket string, service_start_at string, service_end_at string, headway_min int, headway_cv double, n_sessions long, n_valid_days long"),
    }


def lane_average(points, edges, shapes, existing):
    """A plain strategy whose outcome SQL can state: the mean of all traces of a lane at each lattice step.

    The default strategy is the consensus run, whose paths g13 to g25 look at.
    """
    at = points.selectExpr("line_id", "trace_id", "trace_id % 3 AS lane", "cast(round((lon + 66.20D) / 0.00094D) AS int) AS k", "lon", "lat")
    step = at.groupBy("line_id", "lane", "k").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("k", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    riders = at.groupBy("line_id", "lane").agg(F.count_distinct("trace_id").alias("trace_count"))
    out = step.groupBy("line_id", "lane").agg(path.alias("path")).join(riders, ["line_id", "lane"])
    return out.selectExpr("line_id", "element_at(array('main', 'r2', 'r3'), cast(lane AS int) + 1) AS ramal_label", "path", "trace_count")


PARAMS = {"reconstruct_routes": {"strategy": lane_average, "strategy_key": "lane_average", "threshold_m": 1000.0}}
#: Counts that hang on the shape of the paths just built; tests check them, not SQL.
BY_PATH = "step NOT IN ('resolve_edge_votes', 'resolve_routes', 'rebuild_graph')"


def counts_of(run: nightly.Run, tables: nightly.Tables, number: int):
    """The counts of a run's steps and its route versions as rows."""
    steps = run.log.select("step", "status", F.explode("counts").alias("metric", "value"))
    state = F.when(F.col("status") == "superseded", "superseded").otherwise("live")
    versions = tables["routes"].groupBy("version", state.alias("status")).agg(F.count(F.lit(1)).alias("value")).selectExpr(
        "'routes' AS step", "status", "concat('version ', version) AS metric", "value")
    return steps.unionByName(versions).withColumn("run", F.lit(number))


@query("l21_nightly_run", with_tables(f"""WITH mine AS (SELECT *, [0, 2, 3, 6, 7][trace_id % 5 + 1] AS draft_line, [50, 2, 3, 6, 7][trace_id % 5 + 1] AS home FROM trace_points),
    ses AS (SELECT trace_id, any_value(home) AS home, trace_id % 10 = 7 AS silent, count(*) AS n, min(ts) AS started_at, max(ts) AS last_at FROM mine GROUP BY trace_id),
    k AS (SELECT line_id, {KEY} AS key, status, created_at FROM lines), kp AS (SELECT *, first_value(line_id) OVER (PARTITION BY key ORDER BY created_at, line_id) AS keeper FROM k WHERE status = 'draft' AND key <> ''),
    known AS (SELECT DISTINCT key FROM k WHERE status IN ('approved', 'pending')), merged AS (SELECT kp.line_id, CASE WHEN line_id <> keeper THEN 'name' ELSE 'known' END AS why FROM kp LEFT JOIN known USING (key) WHERE line_id <> keeper OR known.key IS NOT NULL),
    lane AS (SELECT home, trace_id % 3 AS lane, max(point_index) + 2 AS vertices FROM mine GROUP BY 1, 2),
    ready AS (SELECT home FROM ses WHERE NOT silent AND n >= 2 GROUP BY 1 HAVING count(*) >= 2),
    built AS (SELECT DISTINCT s.home, s.trace_id % 3 AS lane FROM ses s JOIN ready USING (home) WHERE NOT silent),
    fate AS (SELECT l.home, l.lane, CASE WHEN l.lane = 2 THEN 'create' WHEN l.lane = 0 OR {hav('0', '-17.39', '0.00094 * (l.vertices - ceil(l.vertices * 0.6))', '-17.39')} < 1000 THEN 'unchanged' ELSE 'supersede' END AS fate FROM lane l JOIN built USING (home, lane)),
    tally AS (SELECT line_id, count(*) FILTER (WHERE vote = 'approve') AS f, count(*) FILTER (WHERE vote = 'reject') AS a FROM line_votes GROUP BY 1),
    dow AS (SELECT home, CASE isodow(started_at - INTERVAL 4 HOUR) WHEN 6 THEN 'sat' WHEN 7 THEN 'sun' ELSE 'week' END AS bucket FROM ses WHERE NOT silent),
    z AS (SELECT count(*) AS n, count(boarding_zone_id) AS b, count(alighting_zone_id) AS a, count(*) FILTER (WHERE boarding_zone_id IS NULL OR alighting_zone_id IS NULL) AS open_ FROM zoned_reports),
    c(run, step, status, metric, value) AS (
      SELECT 1, 'cleanup', 'completed', 'abandoned', count(*) FROM ses WHERE silent AND last_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE
      UNION ALL SELECT 1, 'cleanup', 'completed', 'expired', count(*) FROM detours WHERE status = 'active' AND last_confirmed_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY
      UNION ALL SELECT 1, 'deduplicate_lines', 'completed', unnest(['draft_lines', 'merged_by_name', 'merged_into_existing', 'merged_by_overlap', 'promoted_to_pending']),
        unnest([(SELECT count(*) FROM lines WHERE status = 'draft'), (SELECT count(*) FROM merged WHERE why = 'name'), (SELECT count(*) FROM merged WHERE why = 'known'), 0, (SELECT count(*) FROM lines WHERE status = 'draft') - (SELECT count(*) FROM merged)])
      UNION ALL SELECT 1, 'clean_traces', 'completed', unnest(['sessions', 'clean', 'discarded']), unnest([count(*), count(*) FILTER (WHERE n >= 2), count(*) FILTER (WHERE n < 2)]) FROM ses WHERE NOT silent
      UNION ALL SELECT 1, 'reconstruct_routes', 'completed', unnest(['create', 'unchanged', 'supersede', 'rejected', 'lines']), unnest([count(*) FILTER (WHERE fate = 'create'), count(*) FILTER (WHERE fate = 'unchanged'), count(*) FILTER (WHERE fate = 'supersede'), 0, count(DISTINCT home)]) FROM fate
      UNION ALL SELECT 1, 'resolve_line_votes', 'completed', unnest(['checked', 'approved']), unnest([count(*), count(*) FILTER (WHERE f + a >= 3 AND f / CAST(f + a AS DOUBLE) >= 0.6)]) FROM lines LEFT JOIN tally USING (line_id) LEFT JOIN merged m USING (line_id) WHERE status = 'pending' OR (status = 'draft' AND m.line_id IS NULL)
      UNION ALL SELECT 1, 'resolve_fares', 'completed', unnest(['checked', 'boarding_filled', 'alighting_filled', 'unresolved']), unnest([n, b, a, open_]) FROM z
      UNION ALL SELECT 1, 'infer_schedules', 'completed', unnest(['lines', 'rows']), unnest([count(DISTINCT home), count(DISTINCT (home, bucket))]) FROM dow
      UNION ALL SELECT r.run, 'routes', v.state, 'version ' || v.version, v.n FROM (VALUES (1), (2)) AS r(run), (
        SELECT 'live' AS state, 1 AS version, (SELECT count(*) FROM lane WHERE lane < 2) - count(*) FILTER (WHERE fate = 'supersede') + count(*) FILTER (WHERE fate = 'create') AS n FROM fate
        UNION ALL SELECT unnest(['live', 'superseded']), unnest([2, 1]), count(*) FROM fate WHERE fate = 'supersede') AS v WHERE v.n > 0),
    again AS (SELECT 2, step, status, metric, CASE WHEN step = 'resolve_line_votes' AND metric = 'checked' THEN value - (SELECT value FROM c WHERE step = 'resolve_line_votes' AND metric = 'approved') WHEN step = 'resolve_fares' AND metric IN ('checked', 'unresolved') THEN (SELECT open_ FROM z) ELSE 0 END FROM c WHERE run = 1 AND step <> 'routes')
    SELECT run, step, status, metric, CAST(value AS BIGINT) AS value FROM (SELECT * FROM c UNION ALL SELECT * FROM again UNION ALL SELECT 2, 'publish', 'completed', 'parts', 0)""",
    "trace_points", "lines", "line_votes", "detours", "zoned_reports"))
def nightly_run(t: Tables):
    """The ten steps twice, the second time on what the first run published: nothing is left to do or to write."""
    folder = f"{checkpoint_root(t.spark)}/nightly-{uuid.uuid4().hex}"
    first = nightly.run(platform(t), F.to_timestamp(F.lit(NOW)), params=PARAMS)
    nightly.publish(first, folder)
    stored = nightly.published(t.spark, folder, first.tables)
    second = nightly.run(stored, F.to_timestamp(F.lit(NOW)), params=PARAMS)
    parts = nightly.publish(second, folder).join(t.spark.createDataFrame([(n,) for n in first.tables if "line_id" in first.tables[n].columns], "name string"), "name")
    rewritten = parts.agg(F.sum("parts").alias("value")).selectExpr("'publish' AS step", "'completed' AS status", "'parts' AS metric", "value", "2 AS run")
    out = counts_of(first, stored, 1).unionByName(counts_of(second, second.tables, 2)).where(BY_PATH).unionByName(rewritten)
    return snapshot(out.select("run", "step", "status", "metric", "value"))


@query("l21_run_log", with_tables(f"""SELECT step, place, status, value FROM (VALUES ('cleanup', 0, 'completed', (SELECT count(*) FROM detours WHERE status = 'active' AND last_confirmed_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)),
    ('broken', 1, 'failed', NULL), ('resolve_fares', 2, 'completed', (SELECT count(*) FROM zoned_reports WHERE boarding_zone_id IS NULL OR alighting_zone_id IS NULL))) AS v(step, place, status, value)""", "detours", "zoned_reports"))
def run_log(t: Tables):
    """Three steps in a row, the middle one failing: its error is in the log, the others do their work."""
    step = {s.name: s for s in nightly.STEPS}
    broken = nightly.Step("broken", lambda tables, touched, now: nightly.Change({"lines": tables["nowhere"]}), ("cleanup",), ("lines",))
    steps = (step["cleanup"], broken, nightly.Step("resolve_fares", nightly.resolve_fares, ("broken",), ("fare_reports",)))
    done = nightly.run(platform(t), F.to_timestamp(F.lit(NOW)), steps, only=["cleanup", "broken", "resolve_fares", "unknown"])
    count = F.coalesce(F.col("counts")["expired"], F.col("counts")["unresolved"])
    return done.log.select("step", "place", "status", count.alias("value"))
