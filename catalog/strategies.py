"""Reconstruction strategy queries."""

from pyspark.sql import functions as F

from catalog import query
from colectivo.operators import clouds, sequences
from colectivo.plans import strategies as plan
from colectivo.session import snapshot
from fixtures import Tables, with_tables


def traces(t: Tables):
    return plan.Traces(t.trace_points.select("line_id", "trace_id", "point_index", "lon", "lat"), t.trace_edges, t.edge_shapes)


def sized(df, *more):
    return df.select("line_id", "fragment_index", *more, F.size("path").alias("vertices"))


def nodes_of(t: Tables):
    return t.trace_edges.selectExpr("line_id", "trace_id", "seq", "edge_id * 2 + 1 AS node")


@query("r10_registry")
def registry(t: Tables):
    """Every registered strategy with its label, and how many lines it would see."""
    known = t.spark.createDataFrame([(k, v[0]) for k, v in sorted(plan.REGISTRY.items())], "strategy string, label string")
    lines = t.trace_points.select("line_id").distinct().agg(F.count(F.lit(1)).alias("lines"))
    return known.join(lines, F.lit(True))


@query("r11_route_file", with_tables("SELECT line_id, lane AS fragment_index, count(*) + 1 AS vertices FROM route_edges GROUP BY 1, 2", "route_edges"))
def route_file(t: Tables):
    files = t.route_paths.select("line_id", F.col("lane").alias("fragment_index"), "path")
    return sized(plan.reconstruct("route_file", traces(t), files=files))


@query("r12_overlap_join")
def overlap_join(t: Tables):
    return sized(plan.reconstruct("overlap_join", traces(t)), "overlap_merges", "plain_merges", "reversed_traces")


@query("r13_density_clusters")
def density_clusters(t: Tables):
    out = plan.density_clusters(traces(t).points)
    return out.select("line_id", "cluster.trace_id", "cluster.point_index", "points", "distinct_traces", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("r14_ordered_centres")
def ordered_centres(t: Tables):
    stats = snapshot(plan.density_clusters(traces(t).points))
    return clouds.order_by_tree(stats, ["line_id"]).select("line_id", "place", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("r15_density_edges")
def density_edges(t: Tables):
    return plan.density_edges(traces(t).points).select("line_id", "sequence", F.round("confidence", 4).alias("confidence"))


@query("r16_density_grid_search")
def density_grid_search(t: Tables):
    return sized(plan.reconstruct("dbscan_grid_search", traces(t)), "eps", "min_samples", "support", "overlap", "noise", "attempted", "failed")


@query("r17_density_ridge")
def density_ridge(t: Tables):
    return sized(plan.reconstruct("kde", traces(t), bandwidth_m=60.0, cell_m=20.0, share=0.05))


@query("r18_edge_graph")
def edge_graph(t: Tables):
    return sized(plan.reconstruct("edge_graph", traces(t)))


@query("r18_occurrence_counts", with_tables("""SELECT line_id, edge_id * 2 + 1 AS node, count(*) AS weight FROM trace_edges GROUP BY 1, 2""", "trace_edges"))
def occurrence_counts(t: Tables):
    return sequences.occurrence_counts(nodes_of(t), ["line_id"])[0]


@query("r19_segment_vote")
def segment_vote(t: Tables):
    return sized(plan.reconstruct("segment_vote", traces(t), share=0.2), "support")


@query("r19_pair_support", with_tables("""SELECT line_id, u, v, count(DISTINCT trace_id) AS weight FROM (SELECT line_id, trace_id, edge_id * 2 + 1 AS u, lead(edge_id * 2 + 1) OVER (PARTITION BY trace_id ORDER BY seq) AS v FROM trace_edges)
    WHERE v IS NOT NULL GROUP BY 1, 2, 3""", "trace_edges"))
def pair_support(t: Tables):
    return sequences.occurrence_counts(nodes_of(t), ["line_id"], distinct=True)[1]


@query("r20_noise_removal")
def noise_removal(t: Tables):
    out = sequences.drop_internal_noise(nodes_of(t).withColumn("lane", F.expr("trace_id % 3")), ["line_id", "lane"])
    return out.groupBy("line_id", "lane", "trace_id").agg(F.count(F.lit(1)).alias("edges"))


@query("r21_connected_sequences")
def connected_sequences(t: Tables):
    seqs = sequences.collapse_sequences(sequences.as_arrays(nodes_of(t), ["line_id"]), ["line_id"])
    return sequences.connected_sequences(snapshot(seqs), ["line_id"]).select("line_id", "trace_id", "copies", F.size("ids").alias("edges"))


@query("r22_overlap_assembly")
def overlap_assembly(t: Tables):
    return sized(plan.reconstruct("overlap_assembly", traces(t), share=0.2), "traces", "merges", "ambiguous")


@query("r23_representative_shapes", with_tables("SELECT line_id, e.edge_id, 2 AS vertices, round(max(lon1), 6) AS first_lon FROM trace_edges e JOIN edge_geometry USING (edge_id) GROUP BY 1, 2", "trace_edges", "edge_geometry"))
def representative_shapes(t: Tables):
    from colectivo.operators.support import longest_shapes

    out = longest_shapes(t.edge_shapes, ["line_id"])
    return out.select("line_id", "edge_id", F.size("path").alias("vertices"), F.round(F.element_at("path", 1)["lon"], 6).alias("first_lon"))


@query("v01_user_strategy")
def user_strategy(t: Tables):
    """A strategy added from outside the package: the longest trip of each line."""

    own = dict(plan.REGISTRY)

    @plan.register("longest_trip", "Longest trip", registry=own)
    def longest_trip(tr: plan.Traces):
        from colectivo.operators.frechet import shapes_of

        paths = shapes_of(tr.points, ["line_id", "trace_id"], "point_index")
        return paths.groupBy("line_id").agg(F.max_by("path", F.struct(F.size("path"), "trace_id")).alias("path")).withColumn("fragment_index", F.lit(0))

    return sized(plan.reconstruct("longest_trip", traces(t), registry=own))


@query("o05_best_candidate", with_tables("""WITH c AS (SELECT line_id, trace_id, point_index % 5 AS support, event_id % 7 AS overlap, event_id % 11 AS error_m, event_id % 3 AS noise, event_id % 13 AS size, trace_id AS eps, point_index AS min_samples FROM trace_points)
    SELECT line_id, trace_id, support, overlap, error_m FROM c QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY support DESC, overlap DESC, error_m, noise, size, eps, min_samples) = 1""", "trace_points"))
def best_candidate(t: Tables):
    scored = t.trace_points.selectExpr("line_id", "trace_id", "point_index % 5 AS support", "event_id % 7 AS overlap", "event_id % 11 AS error_m", "event_id % 3 AS noise",
                                       "event_id % 13 AS size", "trace_id AS eps", "point_index AS min_samples")
    return plan.best_candidate(scored).select("line_id", "trace_id", "support", "overlap", "error_m")


@query("o04_beam")
def beam(t: Tables):
    lane = nodes_of(t).withColumn("lane", F.expr("trace_id % 3"))
    nodes, pairs = sequences.occurrence_counts(lane, ["line_id", "lane"])
    out = sequences.beam_search(snapshot(nodes), snapshot(pairs), ["line_id", "lane"], width=3, starts=2)
    return out.select("line_id", "lane", "score", F.size("path").alias("edges"))
