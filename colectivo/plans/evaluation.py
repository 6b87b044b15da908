"""Reconstruction quality against known routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.frechet import frechet, shapes_of
from ..operators.grid import segment_cells, spread_join, with_cell
from ..operators.polyline import project, resample_even, to_segments
from ..session import snapshot

CELL_M = 20.0
SEEN_CELL_M = 128.0


def path_points(df: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Vertices of an array path in long form."""
    return df.select(*keys, F.posexplode(path).alias("i", "_p")).select(*keys, F.col("i").cast("bigint").alias("i"), "_p.lon", "_p.lat")


def densify(df: DataFrame, keys: Sequence[str], step_m: float, path: str = "path") -> DataFrame:
    """Paths resampled about every ``step_m``: keys, path."""
    return shapes_of(resample_even(path_points(df, keys, path), keys, "i", step_m), keys)


def coverage_scores(expected: DataFrame, found: DataFrame, on: Sequence[str], keys: Sequence[str], step_m: float = 10.0, tolerance_m: float = 25.0) -> DataFrame:
    """Share of samples of each expected path within 25 m of any found path of its ``on``.

    ``expected``: keys (holding on), path; ``found``: on, line key ``part``, path.
    """
    keys, on = list(keys), list(on)
    samples = resample_even(path_points(expected, keys), keys, "i", max(1.0, step_m))
    ref = samples.groupBy(*on).agg(F.avg("lat").alias("ref_lat"))
    flat = lambda df: df.join(ref, on).withColumns(dict(zip(("px", "py"), geo.radial("lon", "lat", "ref_lat"))))
    lines = flat(path_points(found, [*on, "part"])).select(*on, "part", "i", "px", "py")
    segments = to_segments(lines, [*on, "part"], "i", "px", "py", pos=False).withColumns({"pos": F.lit(0.0), "len": F.lit(0.0)})
    near = project(flat(samples).select(*keys, "k", "px", "py"), segments, on, tolerance_m, [*keys, "k"]).select(*keys, "k", F.lit(1).alias("_hit"))
    return samples.join(near, [*keys, "k"], "left").groupBy(*keys).agg((F.count("_hit") / F.count(F.lit(1))).alias("coverage"))


def clip_to_seen(truth: DataFrame, points: DataFrame, keys: Sequence[str], line: str = "line_id", min_traces: int = 2, tolerance_m: float = 30.0, step_m: float = 10.0) -> DataFrame:
    """Truth cut to the window between its first and last sample seen by enough traces; whole when none is."""
    keys = list(keys)
    samples = resample_even(path_points(truth, keys), keys, "i", step_m)
    ref = samples.groupBy(line).agg(F.min("lat").alias("ref_lat"))
    flat = lambda df: df.join(ref, line).withColumns(dict(zip(("px", "py"), geo.equirect("lon", "lat", "ref_lat"))))
    segments = to_segments(flat(points).select(line, "trace_id", "point_index", "px", "py"), [line, "trace_id"], "point_index", "px", "py", pos=False)
    # Cells wide enough that a segment lies in few; a cell that it meets twice changes no result.
    size = max(tolerance_m, SEEN_CELL_M)
    cells = segment_cells(segments.select(line, "trace_id", "x1", "y1", "x2", "y2"), size, tolerance_m)
    pairs = spread_join(with_cell(flat(samples).select(*dict.fromkeys([*keys, line]), "k", "px", "py"), "px", "py", size), cells, [line, "cx", "cy"])
    near = pairs.where(geo.point_segment("px", "py", "x1", "y1", "x2", "y2") <= tolerance_m)
    if min_traces <= 2:  # least and greatest trace tell one from more, in a row for each sample and task
        several = near.groupBy(*keys, "k").agg(F.min("trace_id").alias("a"), F.max("trace_id").alias("b"))
        enough = several.where("a < b") if min_traces == 2 else several
    else:
        enough = near.select(*keys, "k", "trace_id").distinct().groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_traces)
    window = enough.groupBy(*keys).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    cut = shapes_of(samples.join(window, keys).where("k BETWEEN lo AND hi"), keys)
    return truth.select(*keys, F.col("path").alias("_whole")).join(cut, keys, "left").select(*keys, F.coalesce("path", "_whole").alias("path"))


def edge_precision_recall(observed: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision over observed edges not inferred, recall over all of them.

    ``observed``: keys, edge_id, forward, inferred; ``truth``: keys, edge_id, forward.
    """
    on = [*keys, "edge_id", "forward"]
    edges = observed.groupBy(*on).agg(F.bool_and("inferred").alias("inferred"))
    marked = edges.join(truth.select(*on).distinct().withColumn("_true", F.lit(1)), on, "full")
    own = F.col("inferred") == F.lit(False)
    return marked.groupBy(*keys).agg(
        (F.count(F.when(own & F.col("_true").isNotNull(), 1)) / F.nullif(F.count(F.when(own, 1)), F.lit(0))).alias("edge_precision"),
        (F.count(F.when(F.col("inferred").isNotNull() & F.col("_true").isNotNull(), 1)) / F.nullif(F.count("_true"), F.lit(0))).alias("edge_recall"),
    )


def junction_gaps(edges: DataFrame, keys: Sequence[str], seq: str = "sequence") -> DataFrame:
    """Largest gap between consecutive edges of each route."""
    w = Window.partitionBy(*keys).orderBy(seq)
    before, start = F.lag(F.element_at("path", -1)).over(w), F.element_at("path", 1)
    gaps = edges.where(F.size("path") > 0).withColumn("_b", before)
    gap = geo.haversine(F.col("_b.lon"), F.col("_b.lat"), start["lon"], start["lat"])
    return gaps.groupBy(*keys).agg(F.round(F.coalesce(F.max(gap), F.lit(0.0)), 1).alias("max_junction_gap_m"))


def evaluate_routes(routes: DataFrame, truth: DataFrame, line: str = "line_id") -> DataFrame:
    """Every route against every truth variant and direction of its line.

    ``routes``: line, route_key, path; ``truth``: line, variant, heading, path.
    Both sides are sampled every 10 m. The truth is clipped between the samples
    nearest the route's ends for the overlap distance; what lies outside is
    truncation. Variants per line are few, so the pairs are too.
    """
    a = densify(routes, [line, "route_key"], 10.0).withColumnRenamed("path", "found")
    b = densify(truth, [line, "variant", "heading"], 10.0).withColumnRenamed("path", "truth")
    rows = a.join(b, line)

    def nearest(point):
        gaps = F.transform("truth", lambda p: geo.haversine(p["lon"], p["lat"], point["lon"], point["lat"]))
        return F.array_position(gaps, F.array_min(gaps)).cast("int")

    rows = rows.withColumns({"_i": nearest(F.element_at("found", 1)), "_j": nearest(F.element_at("found", -1))})
    lo, hi = F.least("_i", "_j"), F.greatest("_i", "_j")
    rows = rows.withColumns(
        {
            "clipped": F.slice("truth", lo, hi - lo + 1),
            "start_truncation_m": geo.path_length(F.slice("truth", 1, lo)),
            "end_truncation_m": geo.path_length(F.slice("truth", hi, F.size("truth") - hi + 1)),
        }
    )
    rows = rows.withColumn("frechet_m", frechet("truth", "found"))
    rows = rows.withColumn("_overlap", frechet("clipped", "found"))
    overlap = F.when(F.size("clipped") >= 2, F.col("_overlap")).otherwise(F.col("frechet_m"))
    return rows.select(
        line, "route_key", "variant", "heading", F.round("frechet_m", 1).alias("frechet_m"), F.round(overlap, 1).alias("frechet_overlap_m"),
        F.round("start_truncation_m", 1).alias("start_truncation_m"), F.round("end_truncation_m", 1).alias("end_truncation_m"),
    )


def best_variants(results: DataFrame, line: str = "line_id") -> DataFrame:
    """Result with least overlap distance per route, first variant on ties."""
    rest = [c for c in results.columns if c not in (line, "route_key")]
    best = results.groupBy(line, "route_key").agg(F.min_by(F.struct(*rest), F.struct("frechet_overlap_m", "variant", "heading")).alias("_b"))
    return best.select(line, "route_key", *[F.col(f"_b.{c}").alias(c) for c in rest])


def route_reports(routes: DataFrame, edges: DataFrame, truth: DataFrame, truth_edges: DataFrame, line: str = "line_id") -> DataFrame:
    """One row per route: its best truth with distances and truncation, coverage of that truth, edge precision and recall, gap and counts.

    ``routes``: line, route_key, path; ``edges``: line, route_key, sequence,
    edge_id, forward, inferred, path; ``truth``: line, variant, heading, path;
    ``truth_edges``: line, variant, edge_id, forward.
    """
    key, of = [line, "route_key"], [line, "variant", "heading"]
    best = snapshot(best_variants(evaluate_routes(routes, truth, line), line))
    chosen = best.select(*key, "variant", "heading")
    wanted = chosen.join(truth, of).select(*key, "path")
    covered = coverage_scores(wanted, routes.select(*key, F.lit(0).alias("part"), "path"), key, key)
    own = edges.select(*key, "edge_id", "forward", "inferred")
    right = edge_precision_recall(own, chosen.join(truth_edges, [line, "variant"]).select(*key, "edge_id", "forward"), key)
    counts = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("consensus_edges"), F.count_if("inferred").alias("inferred_edges"))
    out = best.join(covered, key, "left").join(right, key, "left").join(junction_gaps(edges, key), key, "left").join(counts, key, "left")
    share = lambda c: F.round(c, 4).alias(c)
    return out.select(
        *key, "variant", "heading", "frechet_m", "frechet_overlap_m", "start_truncation_m", "end_truncation_m", share("coverage"), share("edge_precision"), share("edge_recall"),
        F.coalesce("max_junction_gap_m", F.lit(0.0)).alias("max_junction_gap_m"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("consensus_edges", "inferred_edges")),
    )


def touched_cells(paths: DataFrame, keys: Sequence[str], on: Sequence[str], ref_lat, dilate: bool = False, step_m: float = 8.0) -> DataFrame:
    """Distinct 20 m cells touched by paths sampled every 8 m: on, cx, cy."""
    dense = resample_even(path_points(paths, keys), keys, "i", step_m)
    x, y = geo.band("lon", "lat", ref_lat)
    cells = dense.select(*on, F.floor(x / CELL_M).cast("bigint").alias("cx"), F.floor(y / CELL_M).cast("bigint").alias("cy")).distinct()
    if not dilate:
        return cells
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    return cells.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).select(
        *on, (F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy")
    ).distinct()


def completeness(envelope: DataFrame, full: DataFrame, found: DataFrame, on: Sequence[str], ref_lat) -> DataFrame:
    """Share of the ridden envelope the reconstruction covers, and the envelope's share of the full routes.

    All inputs: on, part, path.
    """
    on, keys = list(on), [*on, "part"]
    env = touched_cells(envelope, keys, on, ref_lat)
    rec = touched_cells(found, keys, on, ref_lat, dilate=True)
    whole = touched_cells(full, keys, on, ref_lat)
    hit = env.join(rec, [*on, "cx", "cy"], "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("hit"))
    n_env = env.groupBy(*on).agg(F.count(F.lit(1)).alias("n_env"))
    n_full = whole.groupBy(*on).agg(F.count(F.lit(1)).alias("n_full"))
    return n_full.join(n_env, on, "left").join(hit, on, "left").select(
        *on, F.round(F.coalesce("hit", F.lit(0)) / F.col("n_env"), 3).alias("completeness"),
        F.round(F.coalesce("n_env", F.lit(0)) / F.col("n_full"), 3).alias("coverage_envelope"),
    )


def suite_summary(runs: DataFrame) -> DataFrame:
    """Per strategy: runs, successes, failures and means over successes.

    ``runs``: strategy, run, error (null on success), frechet_m, coverage.
    """
    ok = F.col("error").isNull()
    return runs.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        F.avg(F.when(ok, F.col("frechet_m"))).alias("mean_frechet_m"), F.avg(F.when(ok, F.col("coverage"))).alias("mean_coverage"),
    )
