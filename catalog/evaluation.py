"""Evaluation queries."""

from pyspark.sql import functions as F

from catalog import query
from colectivo.operators.frechet import frechet
from colectivo.plans import evaluation as ops
from fixtures import Tables, hav, point_seg, with_tables


def found(t: Tables):
    """Each live route moved by 12 m, as a reconstruction would be off."""
    moved = F.transform("path", lambda p: F.struct(p["lon"].alias("lon"), (p["lat"] + 0.00011).alias("lat")))
    return t.route_paths.select("line_id", F.col("route_id").alias("route_key"), "lane", moved.alias("path"))


def truth(t: Tables):
    both = F.explode(F.array(F.struct(F.lit("ahead").alias("heading"), F.col("path").alias("p")), F.struct(F.lit("back").alias("heading"), F.reverse("path").alias("p"))))
    return t.route_paths.select("line_id", F.concat(F.lit("lane-"), F.col("lane").cast("string")).alias("variant"), both.alias("b")).select("line_id", "variant", "b.heading", F.col("b.p").alias("path"))


@query("e01_frechet_distance", with_tables(f"SELECT route_id, round({hav('0.0', '-17.39', '0.0', '-17.39 + 0.00011')}, 2) AS metres FROM route_edges GROUP BY 1", "route_edges"))
def frechet_distance(t: Tables):
    rows = t.route_paths.select("route_id", "path").join(found(t).select(F.col("route_key").alias("route_id"), F.col("path").alias("moved")), "route_id")
    return rows.select("route_id", F.round(frechet("path", "moved"), 2).alias("metres"))


SAMPLES = f"""tot AS (SELECT route_id, line_id, lane, sum({hav('lon1', 'lat1', 'lon2', 'lat2')}) AS m, min(lon1) AS a, max(lon2) AS b, min(lat1) AS lat FROM route_edges GROUP BY 1, 2, 3),
    smp AS (SELECT route_id, line_id, lane, lat, a + (b - a) * unnest(generate_series(0, n - 1)) / (n - 1) AS lon FROM (SELECT *, greatest(2, CAST(floor(m / 10.0) AS BIGINT) + 1) AS n FROM tot))"""


@query("e02_coverage_score", with_tables(f"""WITH {SAMPLES}, lim AS (SELECT line_id, lane, max(lon2) AS far FROM (SELECT *, count(*) OVER (PARTITION BY line_id, lane) AS n FROM route_edges) WHERE sequence < n // 2 GROUP BY 1, 2)
    SELECT s.route_id, round(count(*) FILTER (WHERE s.lon <= l.far OR radians(s.lon - l.far) * 6371000.0 * cos(radians(s.lat)) <= 25.0) / CAST(count(*) AS DOUBLE), 2) AS coverage
    FROM smp s JOIN lim l USING (line_id, lane) GROUP BY 1""", "route_edges"))
def coverage_score(t: Tables):
    """Coverage by a reconstruction that holds the first half of each lane's edges."""
    expected = t.route_paths.select(F.col("route_id").alias("grp"), "path")
    part = t.route_paths.select(F.col("route_id").alias("grp"), F.lit(0).alias("part"), F.expr("slice(path, 1, (size(path) - 1) div 2 + 1)").alias("path"))
    return ops.coverage_scores(expected, part, ["grp"], ["grp"]).select(F.col("grp").alias("route_id"), F.round("coverage", 2).alias("coverage"))


@query("e03_suite_summary", with_tables("""WITH r AS (SELECT 'strategy-' || (trace_id % 4) AS strategy, CASE WHEN event_id % 6 = 0 THEN 'failed' END AS error, CAST(event_id % 100 AS DOUBLE) AS f, CAST(event_id % 10 AS DOUBLE) / 10 AS c FROM trace_points)
    SELECT strategy, count(*) AS runs, count(*) FILTER (WHERE error IS NULL) AS successes, count(error) AS failures, round(avg(f) FILTER (WHERE error IS NULL), 6) AS mean_frechet_m, round(avg(c) FILTER (WHERE error IS NULL), 6) AS mean_coverage FROM r GROUP BY 1""", "trace_points"))
def suite_summary(t: Tables):
    runs = t.trace_points.selectExpr("concat('strategy-', trace_id % 4) AS strategy", "CASE WHEN event_id % 6 = 0 THEN 'failed' END AS error", "cast(event_id % 100 AS double) AS frechet_m", "cast(event_id % 10 AS double) / 10 AS coverage")
    out = ops.suite_summary(runs)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_frechet_m", "mean_coverage")})


@query("e04_route_evaluation")
def route_evaluation(t: Tables):
    return ops.evaluate_routes(found(t), truth(t))


@query("e04_route_reports", with_tables(f"""WITH k AS (SELECT *, riders < 2 AS inferred FROM route_edges WHERE sequence % 6 <> 5), g AS (SELECT route_id, {hav('lag(lon2) OVER w', 'lag(lat2) OVER w', 'lon1', 'lat1')} AS gap FROM k WINDOW w AS (PARTITION BY route_id ORDER BY sequence)),
    own AS (SELECT route_id, count(*) AS edges, count(*) FILTER (WHERE inferred) AS inferred, count(*) FILTER (WHERE NOT inferred AND sequence % 4 < 2) AS right_own, count(*) FILTER (WHERE NOT inferred) AS all_own, count(*) FILTER (WHERE sequence % 4 < 2) AS right_all FROM k GROUP BY 1),
    tr AS (SELECT route_id, line_id, lane, count(*) FILTER (WHERE sequence % 4 < 2) AS n FROM route_edges GROUP BY 1, 2, 3)
    SELECT t.line_id, t.route_id AS route_key, 'lane-' || lane AS variant, 'ahead' AS heading, round({hav('0.0', '-17.39', '0.0', '-17.39 + 0.00011')}, 1) AS frechet_m, round({hav('0.0', '-17.39', '0.0', '-17.39 + 0.00011')}, 1) AS frechet_overlap_m,
      0.0 AS start_truncation_m, 0.0 AS end_truncation_m, 1.0 AS coverage, round(right_own / nullif(all_own, 0), 4) AS edge_precision, round(right_all / n, 4) AS edge_recall,
      round(coalesce((SELECT max(gap) FROM g WHERE g.route_id = t.route_id), 0), 1) AS max_junction_gap_m, edges AS consensus_edges, inferred AS inferred_edges FROM tr t JOIN own USING (route_id)""", "route_edges"))
def route_reports(t: Tables):
    """Routes 12 m off that lack every sixth edge, against truth that holds half of the road edges."""
    edges = t.route_edges.where("sequence % 6 <> 5").selectExpr("line_id", "route_id AS route_key", "sequence", "edge_id", "forward", "riders < 2 AS inferred", "array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon2, 'lat', lat2)) AS path")
    known = t.route_edges.where("sequence % 4 < 2").selectExpr("line_id", "concat('lane-', lane) AS variant", "edge_id", "forward")
    return ops.route_reports(found(t), edges, truth(t), known)


@query("e07_best_variant", with_tables("SELECT line_id, route_id AS route_key, 'lane-' || lane AS variant, 'ahead' AS heading FROM route_edges GROUP BY ALL", "route_edges"))
def best_variant(t: Tables):
    return ops.best_variants(ops.evaluate_routes(found(t), truth(t))).select("line_id", "route_key", "variant", "heading")


@query("e04_junction_gaps", with_tables(f"""WITH k AS (SELECT * FROM route_edges WHERE sequence % 6 <> 5), g AS (SELECT route_id, {hav('lag(lon2) OVER w', 'lag(lat2) OVER w', 'lon1', 'lat1')} AS gap FROM k WINDOW w AS (PARTITION BY route_id ORDER BY sequence))
    SELECT route_id, round(coalesce(max(gap), 0), 1) AS max_junction_gap_m FROM g GROUP BY 1""", "route_edges"))
def junction_gaps(t: Tables):
    edges = t.route_edges.where("sequence % 6 <> 5").selectExpr("route_id", "sequence", "array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon2, 'lat', lat2)) AS path")
    return ops.junction_gaps(edges, ["route_id"])


@query("e05_clip_to_seen", with_tables(f"""WITH tot AS (SELECT route_id, line_id, count(*) AS edges, sum({hav('lon1', 'lat1', 'lon2', 'lat2')}) AS m, min(lon1) AS a, max(lon2) AS b, min(lat1) AS lat FROM route_edges GROUP BY 1, 2),
    smp AS (SELECT route_id, line_id, lat, k, a + (b - a) * k / (n - 1) AS lon FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, greatest(2, CAST(floor(m / 10.0) AS BIGINT) + 1) AS n FROM tot))),
    ref AS (SELECT line_id, min(lat) AS lat0 FROM smp GROUP BY 1),
    sg AS (SELECT line_id, trace_id, lon * cos(radians(lat0)) * 111320.0 AS x1, lat * 111320.0 AS y1, lon2 * cos(radians(lat0)) * 111320.0 AS x2, lat2 * 111320.0 AS y2 FROM (
      SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY point_index)) JOIN ref USING (line_id) WHERE lon2 IS NOT NULL),
    pt AS (SELECT s.*, lon * cos(radians(lat0)) * 111320.0 AS px, lat * 111320.0 AS py FROM smp s JOIN ref USING (line_id)),
    seen AS (SELECT p.route_id, p.k FROM pt p JOIN sg s ON s.line_id = p.line_id AND p.px BETWEEN s.x1 - 200 AND s.x2 + 200 WHERE {point_seg('p.px', 'p.py', 's.x1', 's.y1', 's.x2', 's.y2')} <= 30.0 GROUP BY 1, 2 HAVING count(DISTINCT trace_id) >= 2),
    win AS (SELECT route_id, max(k) - min(k) + 1 AS n FROM seen GROUP BY 1)
    SELECT t.line_id, t.route_id, coalesce(n, edges + 1) AS vertices FROM tot t LEFT JOIN win USING (route_id)""", "route_edges", "trace_points"))
def clip_to_seen(t: Tables):
    out = ops.clip_to_seen(t.route_paths.select("line_id", "route_id", "path"), t.trace_points, ["line_id", "route_id"])
    return out.select("line_id", "route_id", F.size("path").alias("vertices"))


@query("e06_completeness", with_tables(f"""WITH cut AS (SELECT e.*, q, count(*) OVER (PARTITION BY route_id, q) AS n FROM route_edges e, (VALUES (2), (3), (4)) AS v(q)),
    tot AS (SELECT line_id, lane, q, sum({hav('lon1', 'lat1', 'lon2', 'lat2')}) AS m, min(lon1) AS a, max(lon2) AS b, min(lat1) AS lat FROM cut WHERE sequence < ceil((n + 1) * q / 4) - 1 GROUP BY 1, 2, 3),
    smp AS (SELECT line_id, q, lat, a + (b - a) * unnest(generate_series(0, n - 1)) / (n - 1) AS lon FROM (SELECT *, greatest(2, CAST(floor(m / 8.0) AS BIGINT) + 1) AS n FROM tot)),
    cell AS (SELECT DISTINCT line_id, q, CAST(floor(lon * cos(radians(-17.39)) * 111320.0 / 20) AS BIGINT) AS cx, CAST(floor(lat * 110540.0 / 20) AS BIGINT) AS cy FROM smp),
    wide AS (SELECT DISTINCT line_id, cx + dx AS cx, cy + dy AS cy FROM cell, (VALUES (-1), (0), (1)) AS i(dx), (VALUES (-1), (0), (1)) AS j(dy) WHERE q = 2)
    SELECT line_id, round(count(*) FILTER (WHERE q = 3 AND (line_id, cx, cy) IN (SELECT (line_id, cx, cy) FROM wide)) / CAST(count(*) FILTER (WHERE q = 3) AS DOUBLE), 3) AS completeness,
      round(count(*) FILTER (WHERE q = 3) / CAST(count(*) FILTER (WHERE q = 4) AS DOUBLE), 3) AS coverage_envelope FROM cell GROUP BY 1""", "route_edges"))
def completeness(t: Tables):
    part = lambda path: t.route_paths.select("line_id", F.col("lane").alias("part"), path.alias("path"))
    path, share = F.col("path"), lambda quarters: F.expr(f"slice(path, 1, ceil(size(path) * {quarters} / 4))")
    return ops.completeness(part(share(3)), part(path), part(share(2)), ["line_id"], F.lit(-17.39))


@query("u02_edge_precision_recall", with_tables("""WITH o AS (SELECT DISTINCT trace_id, edge_id, edge_id >= 500000 AS inferred FROM trace_edges), t AS (SELECT r.trace_id, e.edge_id FROM (SELECT DISTINCT trace_id, line_id FROM trace_edges) r
      JOIN route_edges e ON e.line_id = r.line_id AND e.lane = r.trace_id % 3 AND e.sequence % 2 = 0)
    SELECT r.trace_id, round((SELECT count(*) FROM o JOIN t USING (trace_id, edge_id) WHERE trace_id = r.trace_id AND NOT inferred) / CAST((SELECT count(*) FROM o WHERE trace_id = r.trace_id AND NOT inferred) AS DOUBLE), 4) AS edge_precision,
      round((SELECT count(*) FROM o JOIN t USING (trace_id, edge_id) WHERE trace_id = r.trace_id) / CAST((SELECT count(*) FROM t WHERE trace_id = r.trace_id) AS DOUBLE), 4) AS edge_recall
    FROM (SELECT DISTINCT trace_id FROM o) r""", "trace_edges", "route_edges"))
def precision_recall(t: Tables):
    observed = t.trace_edges.selectExpr("trace_id", "edge_id", "forward", "edge_id >= 500000 AS inferred")
    riders = t.trace_edges.select("trace_id", "line_id").distinct().withColumn("lane", F.expr("trace_id % 3"))
    known = t.route_edges.where("sequence % 2 = 0").select("line_id", "lane", "edge_id", "forward").join(riders, ["line_id", "lane"]).select("trace_id", "edge_id", "forward")
    return ops.edge_precision_recall(observed, known, ["trace_id"]).select("trace_id", F.round("edge_precision", 4).alias("edge_precision"), F.round("edge_recall", 4).alias("edge_recall"))


@query("u03_touched_cells", with_tables(f"""WITH {SAMPLES.replace('/ 10.0', '/ 8.0')} SELECT line_id, count(DISTINCT (floor(lon * cos(radians(-17.39)) * 111320.0 / 20), floor(lat * 110540.0 / 20))) AS cells FROM smp GROUP BY 1""", "route_edges"))
def touched_cells(t: Tables):
    paths = t.route_paths.select("line_id", F.col("lane").alias("part"), "path")
    return ops.touched_cells(paths, ["line_id", "part"], ["line_id"], F.lit(-17.39)).groupBy("line_id").agg(F.count(F.lit(1)).alias("cells"))
