"""Polylines in long form: one row per vertex, densely numbered within a key.

Nothing here collects a whole track. Resampling lets every segment produce the
targets that fall on it, so no range join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import snapshot
from .grid import segment_cells, spread_join, with_cell
from .ordered import number_rows, running_sum, with_neighbours

BLOCK = 1 << 16


def headings(points: DataFrame, keys: Sequence[str], idx: str = "point_index") -> DataFrame:
    """Unit heading from the previous to the next point (ends use themselves) and its left normal."""
    out = with_neighbours(points, keys, idx, ["lon", "lat"])
    lon0, lat0 = F.coalesce("prev1_lon", "lon"), F.coalesce("prev1_lat", "lat")
    lon1, lat1 = F.coalesce("next1_lon", "lon"), F.coalesce("next1_lat", "lat")
    mid = F.radians((lat0 + lat1) / 2)
    out = out.withColumns({"_e": (lon1 - lon0) * F.cos(mid), "_n": lat1 - lat0})
    norm = F.sqrt(F.col("_e") * F.col("_e") + F.col("_n") * F.col("_n"))
    out = out.withColumns(
        {
            "heading_e": F.when(norm > 0, F.col("_e") / norm).otherwise(F.lit(1.0)),
            "heading_n": F.when(norm > 0, F.col("_n") / norm).otherwise(F.lit(0.0)),
        }
    )
    return out.withColumns({"left_e": -F.col("heading_n"), "left_n": F.col("heading_e")}).drop(
        "_e", "_n", "prev1_lon", "prev1_lat", "next1_lon", "next1_lat"
    )


def arc_lengths(points: DataFrame, keys: Sequence[str], idx: str = "point_index", metric: str = "haversine") -> DataFrame:
    """Add prev_lon, prev_lat, step and cum (inclusive running length)."""
    out = with_neighbours(points, keys, idx, ["lon", "lat"], before=1, after=0)
    if metric == "haversine":
        step = geo.haversine("prev1_lon", "prev1_lat", "lon", "lat")
    elif metric == "degrees":
        step = geo.dist("prev1_lon", "prev1_lat", "lon", "lat")
    else:
        raise ValueError(metric)
    out = out.withColumn("step", F.coalesce(step, F.lit(0.0)))
    out = running_sum(out, keys, idx, F.col("step"), "cum")
    return out.withColumnsRenamed({"prev1_lon": "prev_lon", "prev1_lat": "prev_lat"})


def arc_fractions(points: DataFrame, keys: Sequence[str], idx: str = "point_index") -> DataFrame:
    """Running length and its share of the whole."""
    out = arc_lengths(points, keys, idx)
    totals = out.groupBy(*keys).agg(F.max("cum").alias("total"))
    return out.join(totals, list(keys)).withColumn(
        "fraction", F.when(F.col("total") > 0, F.col("cum") / F.col("total")).otherwise(F.lit(0.0))
    )


def _segments(points, keys, idx, metric, carry):
    """Segments with the running length at both ends, and the total per key."""
    arcs = arc_lengths(points.select(*keys, idx, "lon", "lat", *carry), keys, idx, metric)
    cols = ["cum", *carry]
    seg = with_neighbours(arcs, keys, idx, cols, before=1, after=0)
    ends = arcs.groupBy(*keys).agg(F.max("cum").alias("total"), F.max(idx).alias("last_idx"))
    return seg.join(ends, list(keys))


def _place(seg, target, carry):
    """Interpolate a target length on its segment."""
    length = F.col("cum") - F.col("prev1_cum")
    frac = F.when(length > 0, (target - F.col("prev1_cum")) / length).otherwise(F.lit(0.0))
    frac = F.least(F.lit(1.0), F.greatest(F.lit(0.0), frac))
    mix = lambda a, b: F.col(a) + frac * (F.col(b) - F.col(a))
    placed = {"_lon": mix("prev_lon", "lon"), "_lat": mix("prev_lat", "lat")}
    for c in carry:
        placed[f"_{c}"] = mix(f"prev1_{c}", c)
    return seg.withColumns(placed)


def resample_even(
    points: DataFrame, keys: Sequence[str], idx: str, step_m: float | None = None, count: int | None = None,
    metric: str = "haversine",
) -> DataFrame:
    """Even points from start to end: about ``step_m`` apart, or exactly ``count`` of them.

    Tracks of zero length keep their first and last point.
    """
    seg = _segments(points, keys, idx, metric, [])
    n = F.lit(count) if count else F.greatest(F.lit(2), F.floor(F.col("total") / max(0.5, step_m)) + 1)
    seg = seg.withColumn("_n", n.cast("bigint")).where(f"{idx} > 0")
    gap = F.col("total") / (F.col("_n") - 1)
    up_to = lambda c: F.least(F.floor(F.col(c) / gap).cast("bigint"), F.col("_n") - 2)
    first, last = F.col(idx) == 1, F.col(idx) == F.col("last_idx")
    lo = F.when(first, F.lit(0).cast("bigint")).otherwise(up_to("prev1_cum") + 1)
    hi = F.when(last, F.col("_n") - 1).otherwise(up_to("cum"))
    flat_lo = F.when(first, F.lit(0).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    flat_hi = F.when(last, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    flat = F.col("total") <= 0
    seg = seg.withColumns({"_lo": F.when(flat, flat_lo).otherwise(lo), "_hi": F.when(flat, flat_hi).otherwise(hi)})
    seg = seg.where("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    target = F.when(flat, F.when(F.col("k") == 0, 0.0).otherwise(F.col("total"))).otherwise(
        F.col("total") * F.col("k") / (F.col("_n") - 1)
    )
    return _place(seg, target, []).select(*keys, "k", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))


def resample_step(
    points: DataFrame, keys: Sequence[str], idx: str, step_m: float, keep_last: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """Points at 0, step, 2·step … and, with ``keep_last``, the final vertex.

    ``carry`` columns (numbers, such as epoch seconds) are interpolated along.
    With ``keep_last=False`` the grid runs to the total length plus 1e-6.
    """
    carry = list(carry)
    seg = _segments(points, keys, idx, "haversine", carry).where(f"{idx} > 0")
    slack = 0.0 if keep_last else 1e-6
    first, last = F.col(idx) == 1, F.col(idx) == F.col("last_idx")
    upto = lambda c, extra: F.floor((F.col(c) + extra) / step_m).cast("bigint")
    seg = seg.withColumns(
        {
            "_lo": F.when(first, F.lit(0).cast("bigint")).otherwise(upto("prev1_cum", 0.0) + 1),
            "_hi": F.when(last, upto("cum", slack)).otherwise(upto("cum", 0.0)),
        }
    )
    grid = seg.where("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    if not keep_last:
        grid = grid.where("total > 0")
    out = _place(grid, F.col("k") * step_m, carry).select(
        *keys, "k", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), *[F.col(f"_{c}").alias(c) for c in carry]
    )
    if not keep_last:
        return out
    tail_k = F.floor(F.col("total") / step_m).cast("bigint")
    tail = seg.where(last & (F.col("total") > tail_k * step_m)).select(*keys, (tail_k + 1).alias("k"), "lon", "lat", *carry)
    single = points.where(F.col(idx) == 0).join(
        seg.select(*keys).distinct(), list(keys), "left_anti"
    ).select(*keys, F.lit(0).cast("bigint").alias("k"), "lon", "lat", *carry)
    return out.unionByName(tail).unionByName(single)


def drop_consecutive_repeats(points: DataFrame, keys: Sequence[str], idx: str = "point_index") -> DataFrame:
    """Remove vertices equal to the one before and number the rest anew."""
    linked = with_neighbours(points, keys, idx, ["lon", "lat"], before=1, after=0)
    kept = linked.where("prev1_lon IS NULL OR prev1_lon <> lon OR prev1_lat <> lat").drop("prev1_lon", "prev1_lat")
    return renumber(kept, keys, idx)


def renumber(df: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Close the gaps of an index after filtering."""
    out = number_rows(df, keys, [idx], F.floor(F.col(idx) / BLOCK), "_new")
    return out.drop(idx).withColumnRenamed("_new", idx).select(*df.columns)


def to_segments(points: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, pos: bool = True) -> DataFrame:
    """Planar segments x1,y1,x2,y2 with ``seg`` number and the arc position of their start."""
    linked = with_neighbours(points.select(*keys, idx, x, y), keys, idx, [x, y], before=0, after=1)
    seg = linked.where(F.col(f"next1_{x}").isNotNull()).select(
        *keys, F.col(idx).alias("seg"), F.col(x).alias("x1"), F.col(y).alias("y1"),
        F.col(f"next1_{x}").alias("x2"), F.col(f"next1_{y}").alias("y2"),
    )
    if not pos:
        return seg
    seg = seg.withColumn("len", geo.dist("x1", "y1", "x2", "y2"))
    return running_sum(seg, keys, "seg", F.col("len"), "_end").withColumn("pos", F.col("_end") - F.col("len")).drop("_end")


def _nearest(points: DataFrame, segments: DataFrame, on: list[str], ids: list[str], near: Column, ring_m: float) -> DataFrame:
    """Best segment of each point of a key that has segments, by rings that grow until the best is proven.

    In a round every open point meets the segments within one cell of its own.
    What it finds within the cell's size can't be beaten by anything it didn't
    meet; points without such a find go on at four times the size, with the
    segments of their keys alone. Rounds grow with the logarithm of the
    distance to the farthest best segment.
    """
    key = list(dict.fromkeys([*on, *ids]))
    real = lambda *cols: " AND ".join(f"abs({c}) < double('infinity')" for c in cols)  # neither null nor NaN
    segments, points = snapshot(segments.where(real("x1", "y1", "x2", "y2"))), points.where(real("px", "py"))
    left, done = snapshot(points.join(segments.select(*on).distinct(), on, "left_semi") if on else points), None
    while True:
        cells = with_cell(left, "px", "py", ring_m)
        met = spread_join(cells, segment_cells(segments, ring_m, ring_m).distinct(), [*on, "cx", "cy"])
        found = snapshot(met.groupBy(*key).agg(F.min(near).alias("_best")).where(F.col("_best.offset_m") <= ring_m))
        done = found if done is None else done.unionByName(found)
        left = snapshot(left.join(found.select(*key), key, "left_anti"))
        if left.isEmpty():
            return done
        if on:
            segments = segments.join(left.select(*on).distinct(), on, "left_semi")
        elif segments.isEmpty():
            return done
        ring_m *= 4


def project(points: DataFrame, segments: DataFrame, on: Sequence[str], within: float | None, point_id: Sequence[str], ring_m: float = 64.0) -> DataFrame:
    """Nearest segment of each point: adds arc_pos and offset_m; first segment wins ties.

    ``points``: point_id, on, px, py ; ``segments``: on, seg, x1…y2,
    pos, len. With ``within`` the pairs come from a grid of that size and far
    points get no row; without it the search widens, from ``ring_m`` on, until
    the nearest is certain; points without coordinates get no row.
    """
    on, point_id = list(on), list(point_id)
    t = geo.segment_fraction("px", "py", "x1", "y1", "x2", "y2")
    near = F.struct(
        geo.point_segment("px", "py", "x1", "y1", "x2", "y2").alias("offset_m"),
        F.col("seg"),
        (F.col("pos") + t * F.col("len")).alias("arc_pos"),
    )
    key = list(dict.fromkeys([*on, *point_id]))
    if within is None:
        best = _nearest(points, segments, on, point_id, near, ring_m)
    else:
        cells = with_cell(points, "px", "py", within)
        pairs = spread_join(cells, segment_cells(segments, within, within).distinct(), [*on, "cx", "cy"])
        best = pairs.groupBy(*key).agg(F.min(near).alias("_best"))
    out = best.select(*key, "_best.offset_m", "_best.seg", "_best.arc_pos")
    return out if within is None else out.where(F.col("offset_m") <= within)


def simplify(points: DataFrame, keys: Sequence[str], idx: str, tolerance: float) -> DataFrame:
    """Kept vertices of Douglas–Peucker in raw degrees, for all tracks at once.

    A round measures every open vertex against the chord of its span, splits
    each span at its farthest vertex, and closes spans below the tolerance.
    Spans shrink fast, so rounds grow with the depth of the split tree.
    """
    keys = list(keys)
    verts = points.select(*keys, F.col(idx).alias("i"), "lon", "lat")
    ends = verts.groupBy(*keys).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    kept = snapshot(ends.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("i")))
    open_verts = snapshot(verts.join(ends, keys).where("i > lo AND i < hi"))
    while True:
        if open_verts.isEmpty():
            break
        spans = open_verts.select(*keys, "lo", "hi").distinct()
        chord = (
            spans.join(verts.select(*keys, F.col("i").alias("lo"), F.col("lon").alias("ax"), F.col("lat").alias("ay")), [*keys, "lo"])
            .join(verts.select(*keys, F.col("i").alias("hi"), F.col("lon").alias("bx"), F.col("lat").alias("by")), [*keys, "hi"])
        )
        measured = open_verts.join(chord, [*keys, "lo", "hi"]).withColumn(
            "d", geo.point_segment("lon", "lat", "ax", "ay", "bx", "by")
        )
        split = snapshot(
            measured.groupBy(*keys, "lo", "hi")
            .agg(F.max("d").alias("d"), F.max_by("i", F.struct("d", -F.col("i"))).alias("at"))
            .where(F.col("d") > tolerance)
            .select(*keys, "lo", "hi", "at")
        )
        if split.isEmpty():
            break
        kept = snapshot(kept.union(split.select(*keys, F.col("at").alias("i"))))
        open_verts = snapshot(
            open_verts.join(split, [*keys, "lo", "hi"])
            .where("i <> at")
            .select(
                *keys, "i", "lon", "lat",
                F.when(F.col("i") < F.col("at"), F.col("lo")).otherwise(F.col("at")).alias("lo"),
                F.when(F.col("i") < F.col("at"), F.col("at")).otherwise(F.col("hi")).alias("hi"),
            )
        )
    return points.join(kept.withColumnRenamed("i", idx), [*keys, idx], "left_semi")


def simplify_stats(points: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    before = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"))
    after = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, list(keys)).withColumn("removed", F.col("before") - F.col("after"))


def detour_stretch(path: DataFrame, route_segments: DataFrame, keys: Sequence[str], on: Sequence[str], idx: str, far_m: float = 50.0) -> DataFrame:
    """First and last index of the divergent stretch of each path against its line's route.

    The stretch runs from the vertex before the first far one to the vertex
    after the last far one; a path never far from the route is kept whole.
    ``path``: keys, on, idx, px, py.
    """
    near = project(path, route_segments, on, far_m, [*keys, idx]).select(*keys, idx, F.lit(True).alias("near"))
    flagged = path.select(*keys, *[o for o in on if o not in keys], idx).join(near, [*keys, idx], "left")
    far = F.col("near").isNull()
    spans = flagged.groupBy(*keys).agg(
        F.min(F.when(far, F.col(idx))).alias("first_far"), F.max(F.when(far, F.col(idx))).alias("last_far"),
        F.max(idx).alias("last_idx"),
    )
    return spans.select(
        *keys,
        F.when(F.col("first_far").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("first_far") - 1)).cast("bigint").alias("start_index"),
        F.when(F.col("first_far").isNull(), F.col("last_idx")).otherwise(F.least("last_idx", F.col("last_far") + 1)).cast("bigint").alias("end_index"),
        F.col("first_far").isNotNull().alias("diverges"),
    )


def paths_in_parts(points: DataFrame, keys: Sequence[str], idx: str, part_points: int = BLOCK) -> DataFrame:
    """Ordered coordinates as ``array<struct<lon,lat>>`` in parts of bounded length.

    Each part starts with the last vertex of the part before, like the parts of
    a MultiLineString, so even a huge track is never one value.
    """
    own = F.floor(F.col(idx) / part_points)
    homes = F.when((F.col(idx) % part_points == 0) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    spread = points.select(*keys, idx, "lon", "lat").withColumn("part", F.explode(homes))
    return (
        spread.groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), "lon", "lat"))).alias("_v"))
        .select(*keys, "part", F.transform("_v", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("path"))
        .where((F.size("path") > 1) | (F.col("part") == 0))
    )
