from pyspark.sql import functions as F

from catalog import query
from colectivo.functions import scalar
from colectivo.operators import votes as ops
from fixtures import Tables, with_tables

def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))

TALLY = "count(*) FILTER (WHERE vote = 'approve') AS votes_for, count(*) FILTER (WHERE vote = 'reject') AS votes_against"


def line_votes(t: Tables):
    return ops.upsert_votes(None, t.line_vote_events, ["line_id", "device_id"], ["created_at", "o_orderkey"]).drop("o_orderkey")


@query("a01_vote_tallies", with_tables(f"SELECT line_id, {TALLY} FROM line_votes GROUP BY 1", "line_votes"))
def vote_tallies(t: Tables):
    return ops.tallies(line_votes(t), "line_id")


@query("l09_line_vote_upsert", with_tables("SELECT line_id, device_id, vote, CAST(created_at AS VARCHAR) AS created_at FROM line_votes", "line_votes"))
def line_vote_upsert(t: Tables):
    return line_votes(t).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("l08_edge_vote_upsert", with_tables("SELECT edge_id, device_id, vote FROM edge_votes", "edge_votes"))
def edge_vote_upsert(t: Tables):
    return t.edge_votes.select("edge_id", "device_id", "vote")


@query("a13_voters_per_edge", with_tables("SELECT edge_id, count(DISTINCT device_id) AS voters FROM edge_votes GROUP BY 1", "edge_votes"))
def voters_per_edge(t: Tables):
    return ops.voters_per_edge(t.edge_votes)


@query("a14_voting_events", with_tables("""SELECT device_id, vote, CAST(date_trunc('second', created_at) AS VARCHAR) AS second, count(*) AS votes,
    string_agg(DISTINCT CAST(edge_id AS VARCHAR), ',' ORDER BY CAST(edge_id AS VARCHAR)) AS edges FROM edge_votes GROUP BY ALL""", "edge_votes"))
def voting_events(t: Tables):
    text = F.array_join(F.sort_array(F.transform("edges", lambda e: e.cast("string"))), ",")
    return ops.voting_events(t.edge_votes).withColumns({"second": F.date_format("second", "yyyy-MM-dd HH:mm:ss"), "edges": text})


def voted_edges(t: Tables):
    """Route edges with counters from the riders' votes and a starting status."""
    counts = ops.tallies(t.route_votes, "route_edge_id")
    return t.route_edges.join(counts, "route_edge_id", "left").fillna(0, ["votes_for", "votes_against"]).withColumn(
        "status", F.expr("CASE WHEN sequence % 11 = 0 THEN 'confirmed' ELSE 'pending' END"))


EDGES = f"""tally AS (SELECT route_edge_id, {TALLY} FROM route_votes GROUP BY 1),
edges AS (SELECT e.*, coalesce(votes_for, 0) AS votes_for, coalesce(votes_against, 0) AS votes_against,
    CASE WHEN sequence % 11 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM route_edges e LEFT JOIN tally USING (route_edge_id)),
resolved AS (SELECT e.*, e.status = 'pending' AND r.route_id IS NOT NULL AS checked,
    e.status = 'pending' AND r.route_id IS NOT NULL AND votes_for + votes_against >= 3 AND votes_for / CAST(votes_for + votes_against AS DOUBLE) >= 0.6 AS hit
    FROM edges e LEFT JOIN (SELECT route_id FROM routes WHERE status <> 'superseded') r USING (route_id))"""


@query("l05_resolve_edge_votes", with_tables(f"""WITH {EDGES} SELECT route_edge_id, CASE WHEN hit THEN 'confirmed' ELSE status END AS status,
    CASE WHEN hit THEN '2024-02-01 00:00:00' END AS confirmed_at FROM resolved""", "route_votes", "routes"))
def resolve_edge_votes(t: Tables):
    out = ops.resolve_edges(voted_edges(t), t.routes, now())
    return out.select("route_edge_id", "status", F.date_format("confirmed_at", "yyyy-MM-dd HH:mm:ss").alias("confirmed_at"))


@query("l05_edge_vote_stats", with_tables(f"""WITH {EDGES} SELECT count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE hit) AS confirmed,
    count(*) FILTER (WHERE checked AND NOT hit) AS still_pending FROM resolved""", "route_votes", "routes"))
def edge_vote_stats(t: Tables):
    return ops.edge_stats(ops.resolve_edges(voted_edges(t), t.routes, now()))


@query("l06_resolve_routes", with_tables(f"""WITH {EDGES}, counts AS (SELECT route_id, count(*) AS n, count(*) FILTER (WHERE hit OR status = 'confirmed') AS k FROM resolved GROUP BY 1)
    SELECT r.route_id, CASE WHEN r.status <> 'pending' THEN 'not_pending' WHEN n IS NULL THEN 'no_edges' WHEN k >= 1 AND k / CAST(n AS DOUBLE) >= 0.8 THEN 'promoted' ELSE 'insufficient' END AS outcome,
    CASE WHEN r.status = 'pending' AND k >= 1 AND k / CAST(n AS DOUBLE) >= 0.8 THEN 'confirmed' ELSE r.status END AS status
    FROM routes r LEFT JOIN counts c USING (route_id)""", "route_votes", "routes"))
def resolve_routes(t: Tables):
    edges = ops.resolve_edges(voted_edges(t), t.routes, now())
    return ops.resolve_routes(t.routes, edges, now()).select("route_id", "outcome", "status")


@query("l07_resolve_line_votes", with_tables(f"""WITH tally AS (SELECT line_id, {TALLY} FROM line_votes GROUP BY 1)
    SELECT l.line_id, CASE WHEN l.status = 'pending' AND votes_for + votes_against >= 3 AND votes_for / CAST(votes_for + votes_against AS DOUBLE) >= 0.6 THEN 'approved' ELSE l.status END AS status
    FROM lines l LEFT JOIN tally USING (line_id)""", "lines", "line_votes"))
def resolve_line_votes(t: Tables):
    return ops.resolve_lines(t.lines, line_votes(t)).select("line_id", "status")


@query("s03_import_votes", with_tables("""WITH fresh AS (SELECT line_id, lane, edge_id, route_edge_id + 500000000 AS new_edge FROM route_edges WHERE sequence % 5 > 0),
    moves AS (SELECT e.route_edge_id AS old_edge, new_edge FROM route_edges e JOIN fresh f ON f.line_id = e.line_id AND f.edge_id = e.edge_id AND f.lane = 0)
    SELECT f.new_edge AS route_edge_id, count(*) FILTER (WHERE vote = 'approve') AS votes_for, count(*) FILTER (WHERE vote = 'reject') AS votes_against, count(vote) AS moved FROM fresh f LEFT JOIN moves USING (new_edge) LEFT JOIN route_votes v ON v.route_edge_id = old_edge GROUP BY 1""", "route_edges", "route_votes"))
def imported_votes(t: Tables):
    """An import in three fragments, each fifth edge gone: the first fragment takes over the votes."""
    new = t.route_edges.where("sequence % 5 > 0").selectExpr("line_id", "cast(lane AS int) AS fragment_index", "route_edge_id + 500000000 AS route_edge_id", "sequence", "edge_id", "forward")
    counted, moved = ops.import_votes(t.route_edges.select("line_id", "route_id", "route_edge_id", "sequence", "edge_id", "forward"), new, t.route_votes)
    own = moved.where("moved").groupBy("route_edge_id").agg(F.count(F.lit(1)).alias("moved"))
    return counted.join(own, "route_edge_id", "left").fillna(0, ["moved"]).select("route_edge_id", "votes_for", "votes_against", "moved")


@query("j13_vote_carry_over", with_tables("""WITH old AS (SELECT line_id, lane, edge_id, max_by(route_edge_id, sequence) AS old_edge FROM route_edges GROUP BY ALL),
    fresh AS (SELECT line_id, lane, edge_id, route_edge_id + 500000000 AS new_edge FROM route_edges WHERE sequence % 5 > 0),
    moves AS (SELECT old_edge, new_edge FROM old JOIN fresh USING (line_id, lane, edge_id))
    SELECT coalesce(new_edge, route_edge_id) AS route_edge_id, device_id, vote, new_edge IS NOT NULL AS moved FROM route_votes LEFT JOIN moves ON old_edge = route_edge_id""",
    "route_edges", "route_votes"))
def vote_carry_over(t: Tables):
    old = t.route_edges.withColumn("ramal_label", F.col("lane").cast("string"))
    new = old.where("sequence % 5 > 0").withColumn("route_edge_id", F.col("route_edge_id") + 500_000_000)
    return ops.carry_votes(old, new, t.route_votes)[1].select("route_edge_id", "device_id", "vote", "moved")


@query("j13_carried_counters", with_tables(f"""WITH tally AS (SELECT route_edge_id, {TALLY} FROM route_votes GROUP BY 1)
    SELECT e.route_edge_id + 500000000 AS route_edge_id, coalesce(votes_for, 0) AS votes_for, coalesce(votes_against, 0) AS votes_against
    FROM route_edges e LEFT JOIN tally USING (route_edge_id) WHERE sequence % 5 > 0""", "route_edges", "route_votes"))
def carried_counters(t: Tables):
    old = t.route_edges.withColumn("ramal_label", F.col("lane").cast("string"))
    new = old.where("sequence % 5 > 0").withColumn("route_edge_id", F.col("route_edge_id") + 500_000_000)
    return ops.carry_votes(old, new, t.route_votes)[0].select("route_edge_id", "votes_for", "votes_against")


KEY = "nullif(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '')"
CREATED = f"""keyed AS (SELECT doc_id AS request_id, route_id, device_id, created_at, {KEY} AS k FROM descriptors),
firsts AS (SELECT route_id, k, min_by(request_id, (created_at, request_id)) AS descriptor_id FROM keyed WHERE k IS NOT NULL GROUP BY 1, 2),
created AS (SELECT keyed.*, descriptor_id, CASE WHEN keyed.k IS NULL THEN 'empty' WHEN request_id = descriptor_id THEN 'created' ELSE 'conflict' END AS outcome
  FROM keyed LEFT JOIN firsts ON keyed.route_id = firsts.route_id AND keyed.k = firsts.k),
actions AS (SELECT c.descriptor_id, v.device, CASE WHEN (c.request_id + v.device) % 3 = 0 THEN 'down' ELSE 'up' END AS action, c.created_at + to_minutes(v.device) AS created_at
  FROM created c, (VALUES (1), (5), (9)) AS v(device) WHERE c.descriptor_id IS NOT NULL),
standing AS (SELECT descriptor_id, device FROM (
    SELECT descriptor_id, device, max_by(action, (created_at, action)) AS action FROM (
      SELECT descriptor_id, device_id AS device, 'up' AS action, created_at FROM created WHERE outcome = 'created' UNION ALL
      SELECT a.descriptor_id, device, action, a.created_at FROM actions a JOIN created c ON c.request_id = a.descriptor_id WHERE a.created_at >= c.created_at) GROUP BY 1, 2)
  WHERE action = 'up')"""


def created(t: Tables):
    return ops.create_descriptors(t.descriptors.withColumnRenamed("doc_id", "request_id"))


def standing(t: Tables):
    made = created(t)
    actions = made.where("descriptor_id IS NOT NULL").selectExpr(
        "descriptor_id", "explode(array(1L, 5L, 9L)) AS device_id", "request_id", "created_at AS at"
    ).selectExpr("descriptor_id", "device_id", "CASE WHEN (request_id + device_id) % 3 = 0 THEN 'down' ELSE 'up' END AS action",
                 "at + make_dt_interval(0, 0, cast(device_id AS int)) AS created_at")
    owners = made.where("outcome = 'created'").select("descriptor_id", "device_id", "created_at")
    return owners, ops.descriptor_votes(owners, actions)


@query("f11_descriptor_key", with_tables(f"SELECT doc_id, {KEY} AS text_normalized FROM descriptors", "descriptors"))
def descriptor_key(t: Tables):
    return t.descriptors.select("doc_id", scalar.descriptor_key(F.col("text")).alias("text_normalized"))


@query("l10_descriptor_create", with_tables(f"WITH {CREATED} SELECT request_id, route_id, descriptor_id, outcome FROM created", "descriptors"))
def descriptor_create(t: Tables):
    return created(t).select("request_id", "route_id", "descriptor_id", "outcome")


@query("l10_descriptor_votes", with_tables(f"WITH {CREATED} SELECT descriptor_id, device AS device_id FROM standing", "descriptors"))
def descriptor_votes(t: Tables):
    return standing(t)[1].select("descriptor_id", "device_id")


@query("o02_descriptors_by_votes", with_tables(f"""WITH {CREATED} SELECT c.descriptor_id, count(s.device) AS votes_count, coalesce(bool_or(s.device = 5), false) AS voted_by_me
    FROM created c LEFT JOIN standing s ON s.descriptor_id = c.descriptor_id WHERE outcome = 'created' GROUP BY 1 ORDER BY votes_count DESC""", "descriptors"))
def descriptors_by_votes(t: Tables):
    owners, votes = standing(t)
    listed = owners.join(t.descriptors.selectExpr("doc_id AS descriptor_id", "route_id"), "descriptor_id")
    return ops.descriptor_list(listed, votes, 5).select("descriptor_id", "votes_count", "voted_by_me")
