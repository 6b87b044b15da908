"""Direction, variant and consensus queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import query
from colectivo.config import Engine
from colectivo.functions import geo
from colectivo.operators import divergence, frechet, repair, support, variants
from colectivo.operators.polyline import resample_step
from colectivo.plans import consensus as plan
from colectivo.session import snapshot
from fixtures import Tables, hav, point_seg, with_tables

LANE = ["line_id", "cluster"]


def points(t: Tables):
    return t.trace_points.select("line_id", "trace_id", "point_index", "lon", "lat")


def laned(df):
    """Lanes as clusters, to study the stages one by one."""
    return df.withColumn("cluster", F.expr("trace_id % 3"))


def graph(t: Tables):
    edges = snapshot(laned(t.trace_edges))
    shapes = snapshot(support.longest_shapes(laned(t.edge_shapes), LANE))
    nodes = snapshot(support.localized_support(support.support_nodes(edges, LANE), shapes, laned(points(t)), LANE))
    return edges, shapes, nodes, snapshot(support.support_arcs(edges, LANE))


NODES = "nodes AS (SELECT line_id, trace_id % 3 AS cluster, edge_id * 2 + 1 AS node, count(DISTINCT trace_id) AS weight FROM trace_edges GROUP BY 1, 2, 3)"
ARCS = """arcs AS (SELECT line_id, trace_id % 3 AS cluster, u, v, count(DISTINCT trace_id) AS support FROM (
    SELECT line_id, trace_id, edge_id * 2 + 1 AS u, lead(edge_id * 2 + 1) OVER (PARTITION BY trace_id ORDER BY seq) AS v FROM trace_edges) WHERE v IS NOT NULL AND u <> v GROUP BY ALL)"""
COVER = """ref AS (SELECT line_id, trace_id % 3 AS cluster, min(lat) AS lat0, count(DISTINCT trace_id) AS traces FROM trace_points GROUP BY 1, 2),
    pc AS (SELECT DISTINCT p.line_id, trace_id % 3 AS cluster, trace_id, CAST(floor(lon * cos(radians(lat0)) * 111320.0 / 100) AS BIGINT) AS cx, CAST(floor(lat * 111320.0 / 100) AS BIGINT) AS cy
      FROM trace_points p JOIN ref r ON r.line_id = p.line_id AND r.cluster = p.trace_id % 3),
    mid AS (SELECT n.*, CAST(floor(lon2 * cos(radians(lat0)) * 111320.0 / 100) AS BIGINT) AS cx, CAST(floor(lat2 * 111320.0 / 100) AS BIGINT) AS cy
      FROM nodes n JOIN ref r USING (line_id, cluster) JOIN edge_geometry g ON g.edge_id = n.node // 2),
    cov AS (SELECT m.line_id, m.cluster, m.node, m.weight, count(DISTINCT p.trace_id) AS coverage FROM mid m LEFT JOIN pc p
      ON p.line_id = m.line_id AND p.cluster = m.cluster AND abs(p.cx - m.cx) <= 1 AND abs(p.cy - m.cy) <= 1 GROUP BY 1, 2, 3, 4),
    sup AS (SELECT *, weight / CAST(greatest(coverage, 1) AS DOUBLE) AS share FROM cov)"""


REFERENCE = f"""stp AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY point_index)),
    rf AS (SELECT line_id, trace_id FROM stp GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY coalesce(sum({hav('lon', 'lat', 'lon2', 'lat2')}), 0) DESC, trace_id) = 1),
    r0 AS (SELECT p.line_id, p.lat AS lat0 FROM trace_points p JOIN rf USING (line_id, trace_id) WHERE point_index = 0),
    sg AS (SELECT line_id, seg, x1, y1, x2, y2, len, sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len AS pos FROM (
      SELECT s.line_id, s.point_index AS seg, lon * cos(radians(lat0)) * 111320.0 AS x1, lat * 111320.0 AS y1, lon2 * cos(radians(lat0)) * 111320.0 AS x2, lat2 * 111320.0 AS y2, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len
      FROM stp s JOIN rf USING (line_id, trace_id) JOIN r0 USING (line_id) WHERE lon2 IS NOT NULL) WHERE len > 0),
    cnt AS (SELECT line_id, trace_id, count(*) AS n, greatest(1, count(*) // 50) AS step FROM trace_points GROUP BY 1, 2),
    smp AS (SELECT p.line_id, p.trace_id, p.point_index, lon * cos(radians(lat0)) * 111320.0 AS px, lat * 111320.0 AS py FROM trace_points p JOIN cnt USING (line_id, trace_id) JOIN r0 USING (line_id) WHERE point_index % step = 0),
    hit AS (SELECT m.line_id, m.trace_id, m.point_index, {point_seg('px', 'py', 'x1', 'y1', 'x2', 'y2')} AS d, seg, pos + len * least(1.0, greatest(0.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len))) AS arc FROM smp m JOIN sg USING (line_id)),
    nr AS (SELECT line_id, trace_id, point_index, arg_min(arc, (d, seg)) AS arc FROM hit WHERE d <= 60.0 GROUP BY 1, 2, 3),
    tv AS (SELECT line_id, trace_id, count(*) AS near, arg_max(arc, point_index) - arg_min(arc, point_index) AS travel FROM nr GROUP BY 1, 2),
    way AS (SELECT line_id, trace_id, CASE WHEN near / ceil(n / step) >= 0.3 AND near >= 2 AND abs(travel) >= 150.0 THEN travel > 0 END AS with_reference FROM cnt LEFT JOIN tv USING (line_id, trace_id))"""


@query("g01_travel_directions", with_tables(f"WITH {REFERENCE} SELECT line_id, trace_id, with_reference FROM way", "trace_points"))
def travel_directions(t: Tables):
    return variants.travel_directions(points(t))


@query("g02_direction_groups", with_tables(f"""WITH RECURSIVE {REFERENCE},
    own AS (SELECT DISTINCT line_id, trace_id, edge_id, forward FROM trace_edges), sizes AS (SELECT line_id, trace_id, count(*) AS n FROM own GROUP BY 1, 2),
    shared AS (SELECT a.line_id, a.trace_id AS a, b.trace_id AS b, count(*) AS shared FROM own a JOIN own b ON b.line_id = a.line_id AND b.edge_id = a.edge_id AND b.forward = a.forward AND b.trace_id <> a.trace_id GROUP BY 1, 2, 3),
    known AS (SELECT line_id, trace_id, CASE WHEN with_reference THEN 'forward' ELSE 'backward' END AS side FROM way WHERE with_reference IS NOT NULL),
    best AS (SELECT s.line_id, s.a AS trace_id, max(s.shared) AS shared, arg_max(side, (s.shared, side)) AS side FROM shared s JOIN known k ON k.line_id = s.line_id AND k.trace_id = s.b
      WHERE (s.line_id, s.a) IN (SELECT (line_id, trace_id) FROM way WHERE with_reference IS NULL) GROUP BY 1, 2),
    joined AS (SELECT line_id, trace_id, side FROM best JOIN sizes USING (line_id, trace_id) WHERE shared >= 5 OR shared / CAST(n AS DOUBLE) >= 0.3),
    alone AS (SELECT line_id, trace_id FROM way WHERE with_reference IS NULL AND (line_id, trace_id) NOT IN (SELECT (line_id, trace_id) FROM joined)),
    tie AS (SELECT s.line_id, a, b FROM shared s JOIN alone x ON x.line_id = s.line_id AND x.trace_id = a JOIN alone y ON y.line_id = s.line_id AND y.trace_id = b JOIN sizes z ON z.line_id = s.line_id AND z.trace_id = a WHERE shared >= 5 OR shared / CAST(n AS DOUBLE) >= 0.3),
    ties AS (SELECT line_id, a, b FROM tie UNION SELECT line_id, b, a FROM tie),
    reach AS (SELECT line_id, trace_id, trace_id AS far FROM alone UNION SELECT r.line_id, r.trace_id, t.b FROM reach r JOIN ties t ON t.line_id = r.line_id AND t.a = r.far),
    sides AS (SELECT * FROM known UNION ALL SELECT * FROM joined UNION ALL SELECT line_id, trace_id, 'part-' || min(far) FROM reach GROUP BY 1, 2),
    place AS (SELECT line_id, side, row_number() OVER (PARTITION BY line_id ORDER BY count(*) DESC, min(trace_id)) - 1 AS direction_group FROM sides GROUP BY 1, 2)
    SELECT line_id, trace_id, CAST(direction_group AS INTEGER) AS direction_group FROM sides JOIN place USING (line_id, side)""", "trace_points", "trace_edges"))
def direction_groups(t: Tables):
    return variants.direction_groups(points(t), t.trace_edges)


@query("g03_compatible_pairs")
def compatible_pairs(t: Tables):
    from colectivo.operators.polyline import resample_even

    shapes = frechet.shapes_of(resample_even(points(t), ["line_id", "trace_id"], "point_index", 25.0), ["line_id", "trace_id"])
    reps, _ = frechet.collapse_copies(shapes, ["line_id"])
    return variants.compatible_pairs(snapshot(reps), ["line_id"])


@query("g04_variant_clusters")
def variant_clusters(t: Tables):
    return variants.cluster_by_compatibility(points(t), ["line_id"])


@query("g05_close_pairs")
def close_pairs(t: Tables):
    shapes = frechet.shapes_of(resample_step(points(t), ["line_id", "trace_id"], "point_index", 25.0), ["line_id", "trace_id"])
    reps, _ = frechet.collapse_copies(shapes, ["line_id"])
    return frechet.close_pairs(snapshot(reps), ["line_id"], 200.0).withColumn("metres", F.round("metres", 3))


@query("g06_linkage_clusters")
def linkage_clusters(t: Tables):
    return variants.cluster_by_frechet(points(t))[0]


def labelled(t: Tables):
    clusters, _ = variants.cluster_by_frechet(points(t))
    clusters = snapshot(clusters)
    shapes = frechet.shapes_of(resample_step(points(t), ["line_id", "trace_id"], "point_index", 25.0), ["line_id", "trace_id"])
    medoids = snapshot(clusters.join(shapes.withColumnRenamed("trace_id", "medoid"), ["line_id", "medoid"]).select("line_id", "cluster", "path"))
    known = medoids.join(clusters, ["line_id", "cluster"]).where("size > 3").select("line_id", F.concat(F.lit("old-"), F.col("cluster").cast("string")).alias("ramal_label"), "path")
    return clusters, medoids, snapshot(known)


@query("g07_stable_labels")
def stable_labels(t: Tables):
    return variants.stable_labels(*labelled(t))


@query("g08_compatibility_labels")
def compatibility_labels(t: Tables):
    clusters, medoids, known = labelled(t)
    return variants.compatibility_labels(clusters, medoids, known.withColumn("place", F.col("ramal_label")))


@query("g09_support_nodes", with_tables(f"WITH {NODES} SELECT * FROM nodes", "trace_edges"))
def support_nodes(t: Tables):
    return support.support_nodes(laned(t.trace_edges), LANE).select("line_id", "cluster", "node", "weight")


@query("g09_support_arcs", with_tables(f"WITH {ARCS} SELECT * FROM arcs", "trace_edges"))
def support_arcs(t: Tables):
    return support.support_arcs(laned(t.trace_edges), LANE)


@query("g10_localized_support", with_tables(f"WITH {NODES}, {COVER} SELECT line_id, cluster, node, coverage, round(share, 6) AS support_share FROM sup", "trace_edges", "trace_points", "edge_geometry"))
def localized_support(t: Tables):
    return graph(t)[2].select("line_id", "cluster", "node", "coverage", F.round("support_share", 6).alias("support_share"))


@query("g11_pruned_arcs", with_tables(f"""WITH {NODES}, {ARCS}, {COVER}, kept AS (SELECT line_id, cluster, node FROM sup WHERE weight >= 2 OR share >= 0.5)
    SELECT a.* FROM arcs a JOIN kept k ON k.line_id = a.line_id AND k.cluster = a.cluster AND k.node = a.u JOIN kept l ON l.line_id = a.line_id AND l.cluster = a.cluster AND l.node = a.v""",
    "trace_edges", "trace_points", "edge_geometry"))
def pruned_arcs(t: Tables):
    _, _, nodes, arcs = graph(t)
    return support.prune(nodes, arcs, LANE)[1].select("line_id", "cluster", "u", "v", "support")


def references(t: Tables):
    """Points of the longest trace of each lane."""
    own = laned(points(t)).withColumn("lane", F.struct(*LANE))
    longest = variants.reference_traces(own.select("lane", "trace_id", "point_index", "lon", "lat"), "lane")
    return snapshot(own.join(longest, (own["lane"] == longest["lane"]) & (own["trace_id"] == longest["reference"]), "left_semi").select(*LANE, "point_index", "lon", "lat"))


def placed(t: Tables):
    edges, shapes, nodes, arcs = graph(t)
    kept, alive, _ = support.prune(nodes, arcs, LANE)
    kept, alive = snapshot(kept), snapshot(alive)
    reference = references(t)
    return edges, shapes, kept, alive, snapshot(support.arc_positions(kept, shapes, reference, LANE))


@query("g12_arc_positions", with_tables(f"""WITH {NODES}, {COVER}, kept AS (SELECT line_id, cluster, node FROM sup WHERE weight >= 2 OR share >= 0.5),
    step AS (SELECT *, first_value(lat) OVER w AS lat0, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY point_index)),
    longest AS (SELECT line_id, trace_id % 3 AS cluster, trace_id FROM step GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY line_id, trace_id % 3 ORDER BY coalesce(sum({hav('lon', 'lat', 'lon2', 'lat2')}), 0) DESC, trace_id) = 1),
    rp AS (SELECT step.*, cluster FROM step JOIN longest USING (line_id, trace_id)),
    rs AS (SELECT *, lon * cos(radians(lat0)) * 111320.0 AS x1, lat * 111320.0 AS y1, lon2 * cos(radians(lat0)) * 111320.0 AS x2, lat2 * 111320.0 AS y2 FROM rp WHERE lon2 IS NOT NULL),
    md AS (SELECT k.*, r.lat0, g.lon2 * cos(radians(r.lat0)) * 111320.0 AS px, g.lat2 * 111320.0 AS py FROM kept k JOIN (SELECT DISTINCT line_id, cluster, lat0 FROM rp) r USING (line_id, cluster) JOIN edge_geometry g ON g.edge_id = k.node // 2)
    SELECT m.line_id, m.cluster, m.node, round(min({point_seg('m.px', 'm.py', 's.x1', 's.y1', 's.x2', 's.y2')}), 3) AS offset_m FROM md m JOIN rs s USING (line_id, cluster) GROUP BY 1, 2, 3""",
    "trace_edges", "trace_points", "edge_geometry"))
def arc_positions(t: Tables):
    edges, shapes, nodes, arcs = graph(t)
    kept, _, _ = support.prune(nodes, arcs, LANE)
    from colectivo.operators.polyline import project, to_segments

    reference = references(t)
    lat0 = reference.where("point_index = 0").select(*LANE, F.col("lat").alias("ref_lat"))
    flat = lambda df: df.join(lat0, LANE).withColumns(dict(zip(("px", "py"), geo.equirect("lon", "lat", "ref_lat"))))
    segs = to_segments(flat(reference), LANE, "point_index", "px", "py")
    mids = shapes.select(*LANE, support.node_id().alias("node"), F.element_at("path", 2).alias("m")).select(*LANE, "node", "m.lon", "m.lat")
    mids = flat(mids.join(kept.select(*LANE, "node"), [*LANE, "node"], "left_semi"))
    out = project(mids.select(*LANE, "node", "px", "py"), segs, LANE, None, ["node"])
    return out.select(*LANE, "node", F.round("offset_m", 3).alias("offset_m"))


@query("g13_endpoints")
def endpoints(t: Tables):
    edges, _, kept, _, positions = placed(t)
    return support.endpoints(kept, edges, positions, LANE)


def path_of(t: Tables):
    edges, shapes, kept, alive, positions = placed(t)
    ends = snapshot(support.endpoints(kept, edges, positions, LANE))
    return edges, shapes, kept, alive, positions, snapshot(support.widest_path(kept, alive, ends, positions, LANE))


@query("g14_widest_path")
def widest_path(t: Tables):
    return path_of(t)[-1]


@query("g15_fragments")
def fragments(t: Tables):
    _, shapes, kept, _, _, path = path_of(t)
    label = path.select(*LANE).distinct().withColumn("ramal_label", F.concat(F.lit("lane-"), F.col("cluster").cast("string")))
    out = support.fragments(support.assemble(path, kept, shapes, LANE).join(label, LANE), LANE)
    return out.select(*LANE, "ramal_label", "fragment", "edges", F.size("path").alias("vertices"), F.round("length_m", 1).alias("length_m"))


def forked(t: Tables):
    """Traces whose last part leaves the lane, to force a fork."""
    edges = laned(t.trace_edges).withColumn("edge_id", F.expr("CASE WHEN seq >= 30 AND trace_id % 2 = 0 THEN edge_id + 100000 ELSE edge_id END"))
    return snapshot(edges)


FORK = """WITH RECURSIVE fe AS (SELECT line_id, trace_id % 3 AS cluster, trace_id, seq, CASE WHEN seq >= 30 AND trace_id % 2 = 0 THEN edge_id + 100000 ELSE edge_id END AS edge_id FROM trace_edges),
    nodes AS (SELECT line_id, cluster, edge_id, edge_id * 2 + 1 AS node FROM fe GROUP BY 1, 2, 3 HAVING count(DISTINCT trace_id) >= 2),
    arcs AS (SELECT DISTINCT s.line_id, s.cluster, s.u, s.v FROM (SELECT line_id, cluster, edge_id * 2 + 1 AS u, lead(edge_id * 2 + 1) OVER (PARTITION BY trace_id ORDER BY seq) AS v FROM fe) s
      JOIN nodes a ON a.line_id = s.line_id AND a.cluster = s.cluster AND a.node = u JOIN nodes b ON b.line_id = s.line_id AND b.cluster = s.cluster AND b.node = v WHERE u <> v),
    path AS (SELECT line_id, cluster, node, edge_id % 1000 AS seq FROM nodes WHERE edge_id < 100000), offp AS (SELECT line_id, cluster, node FROM nodes WHERE edge_id >= 100000),
    link AS (SELECT a.* FROM arcs a JOIN offp x ON x.line_id = a.line_id AND x.cluster = a.cluster AND x.node = u JOIN offp y ON y.line_id = a.line_id AND y.cluster = a.cluster AND y.node = v),
    both_ways AS (SELECT line_id, cluster, u, v FROM link UNION SELECT line_id, cluster, v, u FROM link),
    reach AS (SELECT line_id, cluster, node, node AS far FROM offp UNION SELECT r.line_id, r.cluster, r.node, b.v FROM reach r JOIN both_ways b ON b.line_id = r.line_id AND b.cluster = r.cluster AND b.u = r.far),
    chain AS (SELECT line_id, cluster, node, min(far) AS branch FROM reach GROUP BY 1, 2, 3),
    ent AS (SELECT c.line_id, c.cluster, branch, min(seq) AS e0, max(seq) AS e1 FROM arcs a JOIN path p ON p.line_id = a.line_id AND p.cluster = a.cluster AND p.node = u JOIN chain c ON c.line_id = a.line_id AND c.cluster = a.cluster AND c.node = v GROUP BY 1, 2, 3),
    lea AS (SELECT c.line_id, c.cluster, branch, min(seq) AS x0, max(seq) AS x1 FROM arcs a JOIN path p ON p.line_id = a.line_id AND p.cluster = a.cluster AND p.node = v JOIN chain c ON c.line_id = a.line_id AND c.cluster = a.cluster AND c.node = u GROUP BY 1, 2, 3),
    span AS (SELECT line_id, cluster, branch, CASE WHEN e0 IS NOT NULL AND x0 IS NOT NULL THEN e0 + 1 WHEN x0 IS NOT NULL THEN 0 ELSE e1 + 1 END AS lo, CASE WHEN e0 IS NOT NULL AND x0 IS NOT NULL THEN x1 - 1 WHEN x0 IS NOT NULL THEN x0 - 1 ELSE z END AS hi
      FROM ent FULL JOIN lea USING (line_id, cluster, branch) JOIN (SELECT line_id, cluster, max(seq) AS z FROM path GROUP BY 1, 2) USING (line_id, cluster)),
    br AS (SELECT DISTINCT f.line_id, f.cluster, branch, trace_id FROM fe f JOIN chain c ON c.line_id = f.line_id AND c.cluster = f.cluster AND c.node = f.edge_id * 2 + 1),
    tr AS (SELECT DISTINCT s.line_id, s.cluster, s.branch, f.trace_id FROM fe f JOIN path p ON p.line_id = f.line_id AND p.cluster = f.cluster AND p.node = f.edge_id * 2 + 1 JOIN span s ON s.line_id = f.line_id AND s.cluster = f.cluster AND p.seq BETWEEN lo AND hi),
    good AS (SELECT s.*, (SELECT count(*) FROM chain c WHERE c.line_id = s.line_id AND c.cluster = s.cluster AND c.branch = s.branch) AS edges,
      (SELECT count(*) FROM br WHERE br.line_id = s.line_id AND br.cluster = s.cluster AND br.branch = s.branch) AS branch_traces,
      (SELECT count(*) FROM (SELECT trace_id FROM tr WHERE tr.line_id = s.line_id AND tr.cluster = s.cluster AND tr.branch = s.branch EXCEPT SELECT trace_id FROM br WHERE br.line_id = s.line_id AND br.cluster = s.cluster AND br.branch = s.branch)) AS trunk_traces FROM span s WHERE lo <= hi)
    SELECT line_id, cluster, branch, lo, hi, edges, branch_traces, trunk_traces FROM good WHERE branch_traces >= 2 AND trunk_traces >= 2 QUALIFY row_number() OVER (PARTITION BY line_id, cluster ORDER BY edges DESC, branch) = 1"""


@query("g16_divergence", with_tables(FORK, "trace_edges"))
def find_divergence(t: Tables):
    edges = forked(t)
    nodes = snapshot(support.support_nodes(edges, LANE).withColumn("support_share", F.lit(1.0)).where("weight >= 2"))
    arcs = support.support_arcs(edges, LANE)
    ids = lambda col: nodes.select(*LANE, F.col("node").alias(col))
    arcs = snapshot(arcs.join(ids("u"), [*LANE, "u"], "left_semi").join(ids("v"), [*LANE, "v"], "left_semi"))
    path = snapshot(nodes.where("edge_id < 100000").select(*LANE, (F.col("edge_id") % 1000).alias("seq"), "node"))
    users = edges.select(*LANE, "trace_id", support.node_id().alias("node")).distinct()
    return divergence.detect(nodes, arcs, path, users, LANE)[0]


@query("g18_corridor_spines")
def corridor_spines(t: Tables):
    out = divergence.corridor_spines(laned(points(t)), LANE)
    return out.select(*LANE, F.size("path").alias("vertices"), F.round(geo.path_length("path"), 1).alias("length_m"))


def bent_routes(t: Tables):
    """Live routes with one stretch pushed off the band."""
    bent = F.transform("path", lambda p, i: F.struct(p["lon"].alias("lon"), (p["lat"] + F.when((i >= 10) & (i <= 12), 0.0012).otherwise(0.0)).alias("lat")))
    return t.route_paths.select("line_id", F.col("route_id").alias("route_key"), bent.alias("path"))


@query("g19_dedrift")
def dedrift(t: Tables):
    index = snapshot(repair.trace_index(points(t)))
    out = repair.dedrift(bent_routes(t), index)
    return out.select("line_id", "route_key", F.size("path").alias("vertices"), "repairs")


def gaps_of(t: Tables):
    """A gap in the middle of every live route: four vertices of it, or as many as a short one has."""
    at = lambda shift: F.element_at("path", F.greatest(F.lit(1), F.least(F.size("path"), F.floor(F.size("path") / 2).cast("int") + shift)))
    a, b = at(-2), at(2)
    return snapshot(t.route_paths.select(
        "line_id", F.col("route_id").cast("string").alias("gap_id"), a.alias("start"), b.alias("end"),
        geo.haversine(a["lon"], a["lat"], b["lon"], b["lat"]).alias("gap_m"), F.lit(90.0).alias("heading_in"), F.lit(90.0).alias("heading_out")))


def dense(t: Tables):
    """Trace points every 20 m or so, as real recordings have."""
    from colectivo.operators.polyline import resample_even

    return resample_even(points(t), ["line_id", "trace_id"], "point_index", 20.0).withColumnRenamed("k", "point_index")


@query("g20_trace_stitches")
def trace_stitches(t: Tables):
    index = snapshot(repair.trace_index(dense(t)))
    return repair.stitch_gaps(gaps_of(t), index).select("line_id", "gap_id", F.size("stitch").alias("vertices"))


@query("g21_straight_bridges")
def straight_bridges(t: Tables):
    index = snapshot(repair.trace_index(dense(t)))
    from dataclasses import replace as with_fields

    from colectivo.config import Consensus

    return repair.straight_bridges(gaps_of(t), index, cfg=with_fields(Consensus(), stitch_m=500.0))


@query("g22_cross_trace_bridges")
def cross_bridges(t: Tables):
    index = snapshot(repair.trace_index(dense(t)))
    return repair.cross_bridges(gaps_of(t), index).select("line_id", "gap_id", F.size("cross").alias("vertices"))


def pieces(t: Tables):
    """Each live route cut in the middle, the second half turned round on some lines."""
    half, rest = F.expr("slice(path, 1, (size(path) + 1) div 2)"), F.expr("slice(path, (size(path) + 1) div 2, size(path))")
    cut = t.route_paths.select("line_id", F.lit(0).alias("direction_group"), "route_id", "lane", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), half.alias("path")),
        F.struct(F.lit(1).alias("part"), F.when(F.col("line_id") % 2 == 0, rest).otherwise(F.reverse(rest)).alias("path")))).alias("p"))
    return snapshot(cut.select("line_id", "direction_group", F.concat_ws("-", F.col("route_id").cast("string"), F.col("p.part").cast("string")).alias("route_key"),
                               F.concat_ws(".", F.concat(F.lit("r"), F.col("lane").cast("string")), F.col("p.part").cast("string")).alias("ramal_label"), "p.path", F.lit(3).cast("bigint").alias("trace_count")))


@query("g23_merge_fragments")
def merge_fragments(t: Tables):
    index = snapshot(repair.trace_index(points(t)))
    frags = pieces(t)
    links = snapshot(repair.fragment_links(frags, index, plan.GROUP))
    return repair.merge_fragments(frags, links, plan.GROUP).select("line_id", "ramal_label", "merged_from", F.size("path").alias("vertices"))


@query("g24_validate_routes")
def validate_routes(t: Tables):
    frags = pieces(t)
    members = frags.select("line_id", "direction_group", "route_key").join(t.trace_points.select("line_id", "trace_id").distinct(), "line_id")
    tips = points(t).groupBy("line_id", "trace_id").agg(F.min_by(F.struct("lon", "lat"), "point_index").alias("first"), F.max_by(F.struct("lon", "lat"), "point_index").alias("last"))
    return repair.validate(frags, members, tips, plan.GROUP).select("line_id", "route_key", "ramal_label", "dropped_because", "contained_in")


@query("g25_consensus_routes")
def consensus_routes(t: Tables):
    out = plan.reconstruct(points(t), t.trace_edges, t.edge_shapes)
    return out.routes.select("line_id", "direction_group", "ramal_label", "trace_count", F.size("path").alias("vertices"), F.round("length_m", 1).alias("length_m"))


@query("g17_split_by_divergence")
def split_by_divergence(t: Tables):
    """Top-down discovery on forking traces: every accepted split shows as a variant of its own."""
    by_lane = F.expr("line_id * 10 + trace_id % 3")
    away = F.expr("CASE WHEN trace_id % 2 = 0 AND point_index >= 30 THEN lat + 0.00045D * (point_index - 30) ELSE lat END")
    pts = points(t).withColumns({"line_id": by_lane, "lat": away})
    edges = t.trace_edges.withColumns({"line_id": by_lane, "edge_id": F.expr("CASE WHEN seq >= 30 AND trace_id % 2 = 0 THEN edge_id + 100000 ELSE edge_id END")})
    at = pts.select("trace_id", F.col("point_index").alias("seq"), "lon", "lat")
    shapes = edges.join(at, ["trace_id", "seq"]).groupBy("line_id", "edge_id", "forward").agg(F.min("trace_id").alias("trace_id"), F.min(F.struct("lon", "lat")).alias("a")).selectExpr(
        "line_id", "trace_id", "edge_id", "forward", "array(a, named_struct('lon', a.lon + 0.00094D, 'lat', a.lat)) AS path")
    cfg = Engine(infer_direction=False)
    cfg = replace(cfg, variants=replace(cfg.variants, discovery="divergence", max_divergence_depth=2))
    out = plan.reconstruct(pts, edges, shapes, cfg, repair_routes=False)
    return out.routes.select("line_id", "ramal_label", "trace_count", F.size("path").alias("vertices"))


FLAGS = "f AS (SELECT trace_id, point_index AS k, event_id % 4 <> 0 AS near FROM trace_points)"


@query("w10_far_runs", with_tables(f"""WITH {FLAGS}, n AS (SELECT trace_id, k, k - lag(k) OVER (PARTITION BY trace_id ORDER BY k) - 1 AS gap FROM f WHERE near),
    e AS (SELECT trace_id, min(k) FILTER (WHERE near) AS a, max(k) FILTER (WHERE near) AS b, max(k) AS z FROM f GROUP BY 1)
    SELECT e.trace_id, a AS head_run, coalesce(max(n.gap), 0) AS inner_run, z - b AS tail_run FROM e LEFT JOIN n USING (trace_id) GROUP BY e.trace_id, a, b, z""", "trace_points"))
def far_runs(t: Tables):
    flags = t.trace_points.selectExpr("trace_id", "point_index AS k", "event_id % 4 <> 0 AS near")
    return variants.far_runs(flags, ["trace_id"])


@query("u04_trunk_only_traces", with_tables("""SELECT line_id, trace_id FROM trace_edges WHERE edge_id % 1000 < 40 EXCEPT SELECT line_id, trace_id FROM trace_edges WHERE edge_id >= 500000""", "trace_edges"))
def trunk_only(t: Tables):
    trunk = t.trace_edges.where("edge_id % 1000 < 40").select("line_id", "trace_id").distinct()
    branch = t.trace_edges.where("edge_id >= 500000").select("line_id", "trace_id").distinct()
    return trunk.join(branch, ["line_id", "trace_id"], "left_anti")


@query("v02_bridge_hook")
def bridge_hook(t: Tables):
    """A user bridge closing the gap of every missing edge by a straight line."""
    _, shapes, kept, _, _, path = path_of(t)
    sparse = path.where("seq % 7 <> 3")

    def straight(gaps):
        return gaps.select(*LANE, "seq", F.array("from", "to").alias("bridge"))

    out = support.assemble(sparse, kept, shapes, LANE, straight)
    return out.groupBy(*LANE, "junction").agg(F.count(F.lit(1)).alias("n"))
