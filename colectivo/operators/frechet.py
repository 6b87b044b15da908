"""Discrete Fréchet distance of pair rows.

Spark finds the candidate pairs and deals them to pairs of blocks of tracks; the
distance of a pair is a small dynamic programme over two bounded arrays, run
for many pairs of a task at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import geo
from ..session import snapshot
from .ordered import number_rows
from .quadtree import near_pairs

#: Tracks of a block, and pairs whose distances a task computes at once.
BLOCK, TOGETHER = 512, 256


def discrete_frechet(p: np.ndarray, q: np.ndarray) -> float:
    """Discrete Fréchet distance of two planar point arrays, one anti-diagonal at a time."""
    n, m = len(p), len(q)
    if n == 0 or m == 0:
        return float("nan")
    gap = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    inf = np.inf
    # reach[i] of a diagonal holds the best bottleneck to (i, diagonal - i), shifted by one.
    older, newer = np.full(n + 1, inf), np.full(n + 1, inf)
    for diagonal in range(n + m - 1):
        lo, hi = max(0, diagonal - m + 1), min(n - 1, diagonal)
        i = np.arange(lo, hi + 1)
        if diagonal == 0:
            best = np.zeros(1)
        else:
            best = np.minimum(np.minimum(newer[i], newer[i + 1]), older[i])
        current = np.full(n + 1, inf)
        current[i + 1] = np.maximum(best, gap[i, diagonal - i])
        older, newer = newer, current
    return float(newer[n])


def _padded(rows: Sequence[np.ndarray]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), np.nan)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def frechet_within(p: Sequence[tuple[np.ndarray, np.ndarray]], q: Sequence[tuple[np.ndarray, np.ndarray]], limit: float) -> np.ndarray:
    """Discrete Fréchet distance of each pair of planar tracks (x, y); infinite where it is above ``limit``.

    All pairs advance together, one anti-diagonal at a time, over the span of
    places that any of them reaches without leaving the limit.
    """
    n, m = np.array([len(t[0]) for t in p]), np.array([len(t[0]) for t in q])
    px, py, qx, qy = (_padded([t[c] for t in tracks]) for tracks in (p, q) for c in (0, 1))
    wide, tall = px.shape[1], qx.shape[1]
    out = np.full(len(n), np.inf)
    # Each array holds the best bottleneck to (i, diagonal - i) at i + 1, and is infinite outside its span of i.
    older, newer, current = ((np.full((len(n), wide + 1), np.inf), (0, -1)) for _ in range(3))
    for diagonal in range(wide + tall - 1):
        spans = [s for _, s in (older, newer) if s[0] <= s[1]]
        if diagonal and not spans:
            break
        a = max(diagonal - tall + 1, min((s[0] for s in spans), default=0))
        b = min(wide - 1, diagonal, max((s[1] for s in spans), default=-1) + 1)
        reach, (lo, hi) = current
        reach[:, lo + 1 : hi + 2] = np.inf
        span = (0, -1)
        if a <= b:
            back = slice(diagonal - b, diagonal - a + 1)
            gap = np.hypot(px[:, a : b + 1] - qx[:, back][:, ::-1], py[:, a : b + 1] - qy[:, back][:, ::-1])
            gap[~(gap <= limit)] = np.inf
            if diagonal:
                was, last = older[0], newer[0]
                gap = np.maximum(np.minimum(np.minimum(last[:, a : b + 1], last[:, a + 1 : b + 2]), was[:, a : b + 1]), gap)
            reach[:, a + 1 : b + 2] = gap
            met = np.flatnonzero(np.isfinite(gap).any(0))
            span = (a + int(met[0]), a + int(met[-1])) if len(met) else span
            ends = np.flatnonzero(n + m - 2 == diagonal)
            out[ends] = reach[ends, n[ends]]
        older, newer, current = newer, (reach, span), older
    return out


def _metres(rows_a: Sequence[tuple[np.ndarray, np.ndarray]], rows_b: Sequence[tuple[np.ndarray, np.ndarray]], limit: float) -> np.ndarray:
    """Distances of tracks (lon, lat), each pair projected at the mean latitude of its first."""
    shrink = [np.cos(np.radians(np.mean(a[1]))) for a in rows_a]
    flat = lambda t, k: (np.radians(np.asarray(t[0]) * k) * geo.EARTH_M, np.radians(np.asarray(t[1])) * geo.EARTH_M)
    return frechet_within([flat(a, k) for a, k in zip(rows_a, shrink)], [flat(b, k) for b, k in zip(rows_b, shrink)], limit)


@F.pandas_udf(DoubleType())
def frechet_metres(lon_a: pd.Series, lat_a: pd.Series, lon_b: pd.Series, lat_b: pd.Series) -> pd.Series:
    """Metres between two tracks, projected at the mean latitude of the first."""
    out = []
    for la, pa, lb, pb in zip(lon_a, lat_a, lon_b, lat_b):
        if la is None or lb is None or len(la) == 0 or len(lb) == 0:
            out.append(None)
            continue
        shrink = np.cos(np.radians(np.mean(pa)))
        flat = lambda lon, lat: np.radians(np.column_stack([np.asarray(lon) * shrink, np.asarray(lat)])) * geo.EARTH_M
        out.append(discrete_frechet(flat(la, pa), flat(lb, pb)))
    return pd.Series(out, dtype="float64")


def frechet(path_a: str, path_b: str):
    """Distance column of two ``array<struct<lon,lat>>`` columns."""
    return frechet_metres(f"{path_a}.lon", f"{path_a}.lat", f"{path_b}.lon", f"{path_b}.lat")


def frechet_up_to(path_a: str, path_b: str, limit: float):
    """Like ``frechet``, but null above ``limit``, which costs far less; empty and null paths have no distance."""

    @F.pandas_udf(DoubleType())
    def metres(lon_a: pd.Series, lat_a: pd.Series, lon_b: pd.Series, lat_b: pd.Series) -> pd.Series:
        a, b, out = list(zip(lon_a, lat_a)), list(zip(lon_b, lat_b)), np.full(len(lon_a), np.nan)
        whole = [i for i, (s, t) in enumerate(zip(a, b)) if s[0] is not None and t[0] is not None and len(s[0]) and len(t[0])]
        for k in range(0, len(whole), TOGETHER):
            some = whole[k : k + TOGETHER]
            out[some] = _metres([a[i] for i in some], [b[i] for i in some], limit)
        return pd.Series([float(d) if d <= limit else None for d in out], dtype="float64")

    return metres(f"{path_a}.lon", f"{path_a}.lat", f"{path_b}.lon", f"{path_b}.lat")


def shapes_of(points: DataFrame, keys: Sequence[str], idx: str = "k") -> DataFrame:
    """One path per trip. A resampled trip holds its length over the step in
    vertices, so the array is bounded by the longest bus trip, not by the data."""
    return points.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), "lon", "lat"))),
            lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")),
        ).alias("path")
    )


def collapse_copies(shapes: DataFrame, group: Sequence[str], trace: str = "trace_id") -> tuple[DataFrame, DataFrame]:
    """Keep one trip of each set with the same path.

    Returns the representatives with ``copies``, and trip → representative. Pair
    work then runs on distinct paths only, however often one was uploaded.
    """
    keyed = shapes.withColumn("_h", F.xxhash64("path"))
    reps = keyed.groupBy(*group, "_h", "path").agg(F.min(trace).alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = keyed.join(reps.select(*group, "_h", "path", "rep"), [*group, "_h", "path"]).select(*group, trace, "rep")
    return reps.select(*group, F.col("rep").alias(trace), "path", "copies"), members


def close_pairs(shapes: DataFrame, group: Sequence[str], threshold_m: float, trace: str = "trace_id") -> DataFrame:
    """Pairs (a < b) of one group with Fréchet distance at most ``threshold_m``.

    Both ends of such pairs lie within the threshold, so pairs come from a
    distance join of the first points and a check of the last; farther pairs,
    which no clustering would merge, are never formed. Only ends take part in
    the join. Tracks are numbered along their last points and cut into blocks;
    a task gets the tracks of two blocks, once each, and the pairs between
    them, so paths are copied per pair of blocks that holds a pair.
    """
    on, first, last = list(group), F.element_at("path", 1), F.element_at("path", -1)
    ends = shapes.select(*on, trace, *(p[c].alias(f"{name}_{c}") for name, p in (("f", first), ("l", last)) for c in ("lon", "lat")))
    ends = ends.withColumn("_row", F.floor(F.col("l_lat") * 500))
    strip = F.col("_row") * 1_000_000 + F.floor((F.col("l_lon") + 180.0) * 1000)
    numbered = number_rows(ends, on, ["_row", "l_lon", "l_lat", trace], strip, "_place").withColumn("block", F.floor(F.col("_place") / BLOCK))
    ends = snapshot(numbered.drop("_row", "_place"))
    corners = [f"{end}_{c}" for end in "fl" for c in ("lon", "lat")]
    side = lambda name: ends.select(*on, F.col(trace).alias(name), *(F.col(c).alias(f"{c}_{name}") for c in (*corners, "block")))
    # Mercator units exceed ground metres; 1/cos of the latitude covers the threshold.
    reach = F.lit(threshold_m * 1.05) / F.cos(F.radians(F.least(F.abs("f_lat_b") + threshold_m / 100_000, F.lit(85.0))))
    at = {end: {s: geo.mercator(f"{end}_lon_{s}", f"{end}_lat_{s}") for s in "ab"} for end in "fl"}
    met = near_pairs(side("a"), side("b"), at["f"]["a"], at["f"]["b"], reach, on).where("a < b")
    near = lambda end: geo.dist(*at[end]["a"], *at[end]["b"]) <= reach
    pairs = snapshot(met.where(near("f") & near("l")).select(*on, "a", "b", "block_a", "block_b"))
    key = [*on, "block_a", "block_b"]
    blocks = snapshot(pairs.select(*key).distinct())
    tracks = shapes.join(ends.select(*on, trace, "block"), [*on, trace]).select(*on, "block", F.col(trace).alias("_t"), F.col("path.lon").alias("lon"), F.col("path.lat").alias("lat"))
    met_by = lambda df, name: tracks.withColumnRenamed("block", name).join(df, [*on, name]).select(*key, "_t", "lon", "lat")
    sent = met_by(blocks, "block_a").union(met_by(blocks.where("block_a <> block_b"), "block_b"))

    def measure(asked: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        path = dict(zip(paths["_t"], zip(paths["lon"], paths["lat"])))
        asked = asked.iloc[np.argsort([len(path[a][0]) + len(path[b][0]) for a, b in zip(asked["a"], asked["b"])], kind="stable")]
        metres = [
            _metres([path[a] for a in asked["a"].iloc[k : k + TOGETHER]], [path[b] for b in asked["b"].iloc[k : k + TOGETHER]], threshold_m)
            for k in range(0, len(asked), TOGETHER)
        ]
        out = asked.drop(columns=["block_a", "block_b"]).assign(metres=np.concatenate(metres) if metres else np.zeros(0))
        return out[out["metres"] <= threshold_m]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.drop("block_a", "block_b").schema.fields) + ", metres double"
    return pairs.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(measure, schema).select(*on, "b", "a", "metres")
