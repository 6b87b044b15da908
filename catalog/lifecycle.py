"""Line, session, route, detour and notification lifecycle queries."""

from pyspark.sql import functions as F

from catalog import query
from colectivo.functions import geo
from colectivo.operators import limiter
from colectivo.plans import lifecycle as ops
from colectivo.sources import tables as store
from fixtures import Tables, with_tables

NOW_EVENTS = "2024-01-20 00:00:00"
KEY = "trim(regexp_replace(strip_accents(lower(trim(name))), '^(linea|line|l\\.?)\\s*', ''))"


def at(text):
    return F.to_timestamp(F.lit(text))


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def line_points(t: Tables):
    """Trace points spread over draft lines, so that envelopes overlap."""
    return t.trace_points.selectExpr("(trace_id % 500) * 4 AS line_id", "lon", "lat")


BOX = """box AS (SELECT (trace_id % 500) * 4 AS line_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM trace_points GROUP BY 1)"""
OVER = """ov AS (SELECT a.line_id AS a, b.line_id AS b, CASE WHEN least((a.e - a.w) * (a.n - a.s), (b.e - b.w) * (b.n - b.s)) > 0 THEN
    (least(a.e, b.e) - greatest(a.w, b.w)) * (least(a.n, b.n) - greatest(a.s, b.s)) / least((a.e - a.w) * (a.n - a.s), (b.e - b.w) * (b.n - b.s)) ELSE 0 END AS ratio
    FROM box a JOIN box b ON a.line_id <> b.line_id AND a.w <= b.e AND b.w <= a.e AND a.s <= b.n AND b.s <= a.n)"""


@query("j10_envelope_overlaps", with_tables(f"WITH {BOX}, {OVER} SELECT a, b, round(ratio, 6) AS ratio FROM ov WHERE ratio >= 0.7", "trace_points"))
def envelope_overlaps(t: Tables):
    return ops.envelope_overlaps(ops.line_envelopes(line_points(t))).withColumn("ratio", F.round("ratio", 6))


@query("w13_name_keepers", with_tables(f"WITH k AS (SELECT line_id, {KEY} AS key, created_at FROM lines WHERE status = 'draft') SELECT line_id, key, first_value(line_id) OVER (PARTITION BY key ORDER BY created_at, line_id) AS keeper FROM k WHERE key <> ''", "lines"))
def name_keepers(t: Tables):
    return ops.name_keepers(t.lines)


@query("l01_merge_by_name", with_tables(f"""WITH k AS (SELECT line_id, {KEY} AS key, created_at FROM lines WHERE status = 'draft'), kp AS (SELECT *, first_value(line_id) OVER (PARTITION BY key ORDER BY created_at, line_id) AS keeper FROM k WHERE key <> ''),
    kn AS (SELECT {KEY} AS key, min_by(line_id, (created_at, line_id)) AS target FROM lines WHERE status IN ('approved', 'pending') AND {KEY} <> '' GROUP BY 1)
    SELECT line_id, keeper AS target, 'name' AS why FROM kp WHERE line_id <> keeper UNION ALL SELECT line_id, target, 'known' FROM kp JOIN kn USING (key) WHERE line_id = keeper""", "lines"))
def merge_by_name(t: Tables):
    return ops.deduplicate_lines(t.lines, line_points(t))[1].where("why <> 'overlap'")


@query("l01_deduplicate_lines", with_tables(f"""WITH RECURSIVE {BOX}, {OVER}, pr AS (SELECT a, b, ratio FROM ov WHERE a < b AND ratio >= 0.7),
    r AS (SELECT CAST([] AS BIGINT[]) AS gone, true AS grew
      UNION ALL SELECT coalesce(any_value(x.more), any_value(r.gone)), any_value(x.more) IS NOT NULL FROM r LEFT JOIN LATERAL (
        SELECT list_append(r.gone, arg_min(b, (-ratio, a, b))) AS more FROM pr WHERE NOT list_contains(r.gone, a) AND NOT list_contains(r.gone, b) HAVING count(*) > 0) x ON true WHERE r.grew GROUP BY r.gone),
    n AS (SELECT max(len(gone)) AS n FROM r)
    SELECT (SELECT count(*) FROM lines WHERE status = 'draft') AS draft_lines, 0 AS merged_by_name, 0 AS merged_into_existing, n AS merged_by_overlap, (SELECT count(*) FROM lines WHERE status = 'draft') - n AS promoted_to_pending FROM n""", "lines", "trace_points"))
def deduplicate_lines(t: Tables):
    renamed = t.lines.withColumn("name", F.when(F.col("status") == "draft", F.concat(F.lit("Ruta "), F.col("line_id").cast("string"))).otherwise(F.col("name")))
    return ops.deduplicate_lines(renamed, line_points(t))[2]


MERGE = "m AS (SELECT line_id, line_id + 1 AS target FROM lines WHERE line_id % 5 = 1)"


@query("l02_move_sessions", with_tables(f"WITH {MERGE} SELECT s.session_id, coalesce(m.target, s.line_id) AS line_id, m.target IS NOT NULL AS moved FROM sessions s LEFT JOIN m USING (line_id)", "sessions", "lines"))
def move_sessions(t: Tables):
    merges = t.lines.where("line_id % 5 = 1").selectExpr("line_id", "line_id + 1 AS target")
    return ops.move_rows(t.sessions, merges).select("session_id", "line_id", "moved")


@query("l02_merge_validation", with_tables("""SELECT r.line_id, r.target, CASE WHEN r.line_id = r.target THEN 'same_line' WHEN b.line_id IS NULL THEN 'unknown_line' WHEN r.line_id % 9 = 0 OR r.target % 9 = 0 THEN 'already_merged' END AS rejected_because
    FROM (SELECT line_id, CASE WHEN line_id % 7 = 0 THEN line_id ELSE line_id * 2 END AS target FROM lines) r LEFT JOIN lines b ON b.line_id = r.target
    WHERE r.line_id = r.target OR b.line_id IS NULL OR r.line_id % 9 = 0 OR r.target % 9 = 0""", "lines"))
def merge_validation(t: Tables):
    lines = t.lines.withColumn("status", F.expr("CASE WHEN line_id % 9 = 0 THEN 'merged' ELSE status END"))
    asked = t.lines.selectExpr("line_id", "CASE WHEN line_id % 7 = 0 THEN line_id ELSE line_id * 2 END AS target")
    return ops.valid_merges(asked, lines)[1]


@query("l03_abandon_stale", with_tables(f"""SELECT session_id, CASE WHEN stale THEN 'abandoned' ELSE status END AS status, stale AS abandoned_now,
    strftime(CASE WHEN stale THEN last_activity_at ELSE ended_at END, '%Y-%m-%d %H:%M:%S') AS ended_at
    FROM (SELECT *, status = 'in_progress' AND last_activity_at < TIMESTAMP '{NOW_EVENTS}' - INTERVAL 30 MINUTE AS stale FROM sessions)""", "sessions"))
def abandon_stale(t: Tables):
    return ops.abandon_stale(t.sessions, at(NOW_EVENTS)).select("session_id", "status", "abandoned_now", stamp("ended_at").alias("ended_at"))


@query("l04_expire_detours", with_tables("""SELECT detour_id, CASE WHEN status = 'active' AND last_confirmed_at < TIMESTAMP '1998-06-01' - INTERVAL 7 DAY THEN 'expired' ELSE status END AS status FROM detours""", "detours"))
def expire_detours(t: Tables):
    return ops.expire_detours(t.detours, at("1998-06-01 00:00:00")).select("detour_id", "status")


@query("l04_confirm_detours", with_tables("""WITH c AS (SELECT l_orderkey AS detour_id, count(*) AS n, max(l_shipdate) AS at FROM lineitem GROUP BY 1)
    SELECT d.detour_id, CASE WHEN status = 'active' AND n IS NOT NULL THEN confirmed_count + n ELSE confirmed_count END AS confirmed_count,
    CAST(CASE WHEN status = 'active' AND n IS NOT NULL THEN greatest(last_confirmed_at, at) ELSE last_confirmed_at END AS VARCHAR) AS last_confirmed_at FROM detours d LEFT JOIN c USING (detour_id)""".replace("max(l_shipdate) AS at", "max(l_shipdate) AS at_").replace("last_confirmed_at, at)", "last_confirmed_at, at_)"), "detours"))
def confirm_detours(t: Tables):
    confirms = t.raw("lineitem").selectExpr("l_orderkey AS detour_id", "l_shipdate AS at")
    return ops.confirm_detours(t.detours, confirms).select("detour_id", "confirmed_count", stamp("last_confirmed_at").alias("last_confirmed_at"))


@query("l11_version_decisions", with_tables("""SELECT r.line_id, r.ramal_label, CASE WHEN r.line_id = 4 THEN 'create' WHEN r.line_id % 2 = 0 THEN 'unchanged' ELSE 'supersede' END AS decision,
    CASE WHEN r.line_id % 2 = 0 AND r.line_id <> 4 THEN NULL ELSE 3 END AS version FROM routes r WHERE status <> 'superseded'""", "routes"))
def version_decisions(t: Tables):
    """Even lines are rebuilt 20 m off, odd ones 110 m off, and line 4 has no live route."""
    d, active = decisions(t)
    return d.select("line_id", "ramal_label", "decision", F.col("version").cast("int").alias("version"))


def decisions(t: Tables):
    live = t.routes.where("status <> 'superseded'").join(t.route_paths.select("route_id", "path"), "route_id")
    shift = F.when(F.col("line_id") % 2 == 0, 0.00018).otherwise(0.001)
    moved = F.transform("path", lambda p: F.struct(p["lon"].alias("lon"), (p["lat"] + shift).alias("lat")))
    candidates = live.select("line_id", "ramal_label", moved.alias("path"))
    active = live.where("line_id <> 4").select("line_id", "ramal_label", "route_id", "path")
    return ops.version_decisions(candidates, active, t.routes, at("2024-02-01 00:00:00")), active


@query("l11_apply_versions", with_tables("""SELECT CAST(route_id AS VARCHAR) AS route_id, CASE WHEN status <> 'superseded' AND line_id % 2 = 1 THEN 'superseded' ELSE status END AS status FROM routes
    UNION ALL SELECT line_id || '/' || ramal_label || '/v3', 'pending' FROM routes WHERE status <> 'superseded' AND (line_id % 2 = 1 OR line_id = 4)""", "routes"))
def apply_versions(t: Tables):
    return ops.apply_versions(t.routes, decisions(t)[0], "overlap_assembly").select("route_id", "status")


@query("l12_route_edges", with_tables("""SELECT route_id, CAST(count(DISTINCT sequence // 3) AS BIGINT) AS edges, CAST(count(*) + 1 + count(DISTINCT sequence // 3) - 1 AS BIGINT) AS vertices FROM route_edges GROUP BY 1 HAVING count(*) % 3 > 0 OR true""", "route_edges"))
def cut_route_edges(t: Tables):
    """Consensus coordinates cut every three lattice steps; every fifth point is unmatched."""
    pts = t.route_paths.select("route_id", F.posexplode("path").alias("i", "p"), F.size("path").alias("n")).select(
        "route_id", "i", "p.lon", "p.lat", F.when((F.col("i") % 3 != 0) & (F.col("i") % 5 == 4), None).otherwise(F.floor(F.least(F.col("i"), F.col("n") - 2) / 3).cast("int")).alias("edge_index"))
    roads = t.route_edges.selectExpr("route_id", "cast(sequence div 3 AS int) AS edge_index").distinct().selectExpr("route_id", "edge_index", "cast(edge_index AS bigint) * 10 AS edge_id", "true AS forward")
    cut = ops.edges_of_route(pts, roads)
    return cut.groupBy("route_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.size("path")).alias("vertices"))


@query("w05_street_summary", with_tables("""WITH e AS (SELECT trace_id, seq, CASE WHEN seq % 11 = 10 THEN NULL ELSE 'Calle ' || (seq // 4 % 3) END AS street, 0.06 + 0.01 * (edge_id % 3) AS km FROM trace_edges),
    r AS (SELECT *, sum(CASE WHEN street IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY seq) AS run FROM (SELECT *, lag(street) OVER (PARTITION BY trace_id ORDER BY seq) AS p FROM e)),
    g AS (SELECT trace_id, run, street, sum(km * 1000) AS m FROM r WHERE street IS NOT NULL GROUP BY ALL HAVING round(sum(km * 1000), 3) >= 250),
    k AS (SELECT *, lag(street) OVER (PARTITION BY trace_id ORDER BY run) AS before FROM g)
    SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY run) - 1 AS place, street FROM k WHERE before IS NULL OR before <> street""", "trace_edges"))
def street_summary(t: Tables):
    edges = t.trace_edges.selectExpr("trace_id", "seq", "CASE WHEN seq % 11 = 10 THEN NULL ELSE concat('Calle ', seq div 4 % 3) END AS street", "0.06D + 0.01D * (edge_id % 3) AS length_km")
    return ops.street_summary(edges, ["trace_id"], min_run_m=249.9995)


@query("l13_supersede_fragmented", with_tables("SELECT route_id, CASE WHEN status <> 'superseded' AND fragment_count > 1 THEN 'superseded' ELSE status END AS status FROM routes", "routes"))
def supersede_fragmented(t: Tables):
    return ops.supersede_fragmented(t.routes).select("route_id", "status")


LIMIT = """e AS (SELECT device_id, line_id, event_id, epoch_us(sent_at) AS us, row_number() OVER (PARTITION BY device_id, line_id ORDER BY sent_at, event_id) AS n FROM detour_events),
  s AS (SELECT device_id, line_id, event_id, n, [us] AS singles, CAST(NULL AS BIGINT) AS summ, 'individual' AS decision FROM e WHERE n = 1
    UNION ALL SELECT e.device_id, e.line_id, e.event_id, e.n,
      CASE WHEN (s.summ IS NULL OR s.summ < e.us - 86400000000) AND len(list_filter(s.singles, lambda x: x >= e.us - 86400000000)) < 3 THEN list_append(list_filter(s.singles, lambda x: x >= e.us - 86400000000), e.us) ELSE s.singles END,
      CASE WHEN (s.summ IS NULL OR s.summ < e.us - 86400000000) AND len(list_filter(s.singles, lambda x: x >= e.us - 86400000000)) >= 3 THEN e.us ELSE s.summ END,
      CASE WHEN s.summ >= e.us - 86400000000 THEN 'skipped' WHEN len(list_filter(s.singles, lambda x: x >= e.us - 86400000000)) < 3 THEN 'individual' ELSE 'coalesced' END
    FROM s JOIN e ON e.device_id = s.device_id AND e.line_id = s.line_id AND e.n = s.n + 1)"""


@query("l18_notification_history", with_tables(f"WITH RECURSIVE {LIMIT} SELECT device_id, line_id, event_id, decision FROM s", "detour_events"))
def notification_history(t: Tables):
    return limiter.limit_history(t.detour_events).select("device_id", "line_id", "event_id", "decision")


@query("l18_dispatch_decisions", with_tables(f"""WITH lg AS (SELECT device_id, line_id, CASE WHEN event_id % 9 = 0 THEN 'coalesced' ELSE 'individual' END AS kind, sent_at FROM detour_events),
    r AS (SELECT device_id, line_id, count(*) FILTER (WHERE kind = 'individual') AS i, count(*) FILTER (WHERE kind = 'coalesced') AS c FROM lg
      WHERE sent_at >= TIMESTAMP '{NOW_EVENTS}' - INTERVAL 24 HOUR AND sent_at <= TIMESTAMP '{NOW_EVENTS}' GROUP BY 1, 2)
    SELECT t.device_id, t.line_id, CASE WHEN coalesce(c, 0) >= 1 THEN 'skipped' WHEN coalesce(i, 0) < 3 THEN 'individual' ELSE 'coalesced' END AS decision
    FROM (SELECT DISTINCT device_id, line_id FROM detour_events) t LEFT JOIN r USING (device_id, line_id)""", "detour_events"))
def dispatch_decisions(t: Tables):
    log = t.detour_events.selectExpr("device_id", "line_id", "CASE WHEN event_id % 9 = 0 THEN 'coalesced' ELSE 'individual' END AS kind", "sent_at")
    return ops.dispatch_decisions(t.detour_events.select("device_id", "line_id").distinct(), log, at(NOW_EVENTS))


@query("l19_device_upsert", with_tables("""WITH u AS (SELECT user_id AS device_id, max_by(CASE WHEN event_id % 3 = 0 THEN 'tok-' || event_id END, CASE WHEN event_id % 3 = 0 THEN ts END) AS tok, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1),
    c AS (SELECT c_custkey AS device_id, 'old' AS tok, TIMESTAMP '2020-01-01' AS a FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(u.device_id, c.device_id) AS device_id, coalesce(u.tok, c.tok) AS push_token, strftime(coalesce(c.a, u.a), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(coalesce(u.b, c.a), '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM u FULL JOIN c ON c.device_id = u.device_id"""))
def device_upsert(t: Tables):
    current = t.raw("customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS device_id", "'old' AS push_token", "cast(NULL AS string) AS platform", "cast(NULL AS string) AS locale",
        "timestamp'2020-01-01 00:00:00' AS last_seen_at", "timestamp'2020-01-01 00:00:00' AS created_at")
    updates = t.raw("events").selectExpr("user_id AS device_id", "CASE WHEN event_id % 3 = 0 THEN concat('tok-', event_id) END AS push_token", "cast(NULL AS string) AS platform", "cast(NULL AS string) AS locale", "cast(ts AS timestamp) AS at")
    return store.upsert_devices(current, updates).select("device_id", "push_token", stamp("created_at").alias("created_at"), stamp("last_seen_at").alias("last_seen_at"))


@query("l19_replace_subscriptions", with_tables("""WITH r AS (SELECT user_id AS device_id, max_by(event_id % 40, ts) AS l FROM events GROUP BY 1)
    SELECT c_custkey AS device_id, c_custkey % 5 AS line_id FROM customer WHERE c_custkey NOT IN (SELECT device_id FROM r) UNION ALL SELECT device_id, unnest(list_distinct([l, l + 1, l])) FROM r"""))
def replace_subscriptions(t: Tables):
    current = t.raw("customer").selectExpr("c_custkey AS device_id", "c_custkey % 5 AS line_id", "'commute' AS kind")
    asked = t.raw("events").selectExpr("user_id AS device_id", "array(event_id % 40, event_id % 40 + 1, event_id % 40) AS line_ids", "ts AS at")
    return store.replace_subscriptions(current, asked).select("device_id", "line_id")


@query("l20_delete_lines", with_tables("""SELECT 'sessions' AS tbl, count(*) AS rows_left FROM sessions WHERE line_id <> 2 UNION ALL SELECT 'routes', count(*) FROM routes WHERE line_id <> 2
    UNION ALL SELECT 'route_edges', count(*) FROM route_edges WHERE line_id <> 2 UNION ALL SELECT 'edge_votes', count(*) FROM route_votes WHERE route_edge_id // 10000000 <> 2""",
    "sessions", "routes", "route_edges", "route_votes"))
def delete_lines(t: Tables):
    ids = t.lines.where("line_id = 2").select("line_id")
    left = ops.delete_lines(ids, {"sessions": t.sessions, "routes": t.routes, "route_edges": t.route_edges.drop("line_id"), "edge_votes": t.route_votes})
    count = lambda name: left[name].agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("rows_left"))
    return count("sessions").union(count("routes")).union(count("route_edges")).union(count("edge_votes"))


@query("l22_line_changes", with_tables("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS change_id, l_partkey AS line_id, CASE l_linenumber % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'approve' ELSE 'delete' END AS action FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_shipdate) = 1)
    SELECT l.line_id, CASE WHEN c.action = 'approve' AND l.status = 'pending' THEN 'approved' ELSE l.status END AS status, CASE WHEN c.action = 'update' THEN 'renamed' ELSE l.name END AS name
    FROM lines l LEFT JOIN c USING (line_id) WHERE c.action IS NULL OR c.action <> 'delete'""", "lines"))
def line_changes(t: Tables):
    asked = t.raw("lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS change_id", "l_partkey AS line_id", "CASE l_linenumber % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'approve' ELSE 'delete' END AS action")
    changes = asked.selectExpr("*", "CASE WHEN action = 'update' THEN 'renamed' END AS name", "cast(NULL AS string) AS line_type", "timestamp'2024-01-01 00:00:00' AS at")
    return ops.change_lines(t.lines, changes)[0].select("line_id", "status", "name")


@query("l22_session_changes", with_tables("""SELECT session_id, action, CASE WHEN action IN ('cancel', 'assign') AND status <> 'in_progress' THEN 'not_in_progress' WHEN action = 'resume' AND status <> 'abandoned' THEN 'not_abandoned' ELSE 'exists' END AS rejected_because
    FROM (SELECT *, CASE session_id % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'assign' WHEN 2 THEN 'resume' ELSE 'start' END AS action FROM sessions)
    WHERE action = 'start' OR (action IN ('cancel', 'assign') AND status <> 'in_progress') OR (action = 'resume' AND status <> 'abandoned')""", "sessions"))
def session_changes(t: Tables):
    changes = t.sessions.selectExpr("session_id AS change_id", "session_id", "CASE session_id % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'assign' WHEN 2 THEN 'resume' ELSE 'start' END AS action", "device_id + 1 AS device_id", "started_at AS at")
    return ops.change_sessions(t.sessions, changes)[1].select("session_id", "action", "rejected_because")
