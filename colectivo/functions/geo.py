"""Geometry as column expressions: one function per metre convention.

Results depend on the convention, so callers name the one they need and never
mix them. All functions take and return columns; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Sphere radius and metres per degree of each convention.
EARTH_M = 6_371_000.0
DEG_M = 111_320.0
DEG_LAT_M = 110_540.0
MERCATOR_M = 6_378_137.0

PATH_TYPE = "array<struct<lon:double,lat:double>>"


def haversine(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = (_c(v) for v in (lon1, lat1, lon2, lat2))
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def offset(lon, lat, east_m, north_m) -> tuple[Column, Column]:
    """Move a point by metres on the sphere of radius ``EARTH_M``."""
    lon, lat, east_m, north_m = (_c(v) for v in (lon, lat, east_m, north_m))
    shrink = F.greatest(F.lit(1e-6), F.cos(F.radians(lat)))
    return (
        lon + F.degrees(east_m / (EARTH_M * shrink)),
        lat + F.degrees(north_m / EARTH_M),
    )


def equirect(lon, lat, ref_lat) -> tuple[Column, Column]:
    """Consensus, variants and direction: 111 320 m per degree on both axes."""
    lon, lat, ref_lat = _c(lon), _c(lat), _c(ref_lat)
    return lon * F.cos(F.radians(ref_lat)) * DEG_M, lat * DEG_M


def band(lon, lat, ref_lat) -> tuple[Column, Column]:
    """Despike band and coverage cells: 111 320 / 110 540 m per degree."""
    lon, lat, ref_lat = _c(lon), _c(lat), _c(ref_lat)
    return lon * F.cos(F.radians(ref_lat)) * DEG_M, lat * DEG_LAT_M


def radial(lon, lat, ref_lat) -> tuple[Column, Column]:
    """Fréchet and coverage score: radians times the sphere radius."""
    lon, lat, ref_lat = _c(lon), _c(lat), _c(ref_lat)
    return F.radians(lon) * EARTH_M * F.cos(F.radians(ref_lat)), F.radians(lat) * EARTH_M


def mercator(lon, lat) -> tuple[Column, Column]:
    """Vote overlap: Web-Mercator units, inflated by 1/cos(lat) against ground metres."""
    lon, lat = _c(lon), _c(lat)
    return (
        F.radians(lon) * MERCATOR_M,
        F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_M,
    )


def dist(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy)


def segment_fraction(px, py, ax, ay, bx, by) -> Column:
    """Position in [0, 1] of the nearest point of segment a–b; 0 for a zero-length one."""
    px, py, ax, ay, bx, by = (_c(v) for v in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len_sq = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / len_sq
    return F.when(len_sq == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def point_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment."""
    px, py, ax, ay, bx, by = (_c(v) for v in (px, py, ax, ay, bx, by))
    t = segment_fraction(px, py, ax, ay, bx, by)
    return dist(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """True when segments a–b and c–d cross at an inner point."""
    ax, ay, bx, by, cx, cy, dx, dy = (_c(v) for v in (ax, ay, bx, by, cx, cy, dx, dy))

    def side(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (
        side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0
    )


def segment_segment(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance between two segments: 0 when they cross, else the nearest end."""
    nearest = F.least(
        point_segment(ax, ay, cx, cy, dx, dy),
        point_segment(bx, by, cx, cy, dx, dy),
        point_segment(cx, cy, ax, ay, bx, by),
        point_segment(dx, dy, ax, ay, bx, by),
    )
    return F.when(segments_cross(ax, ay, bx, by, cx, cy, dx, dy), F.lit(0.0)).otherwise(nearest)


def boxes_within(left: str, right: str, d: float) -> Column:
    """Cheap test before an exact one: bounding boxes of two aliased segments at most ``d`` apart."""

    def apart(a1, a2):
        l1, l2, r1, r2 = (F.col(f"{left}.{a1}"), F.col(f"{left}.{a2}"), F.col(f"{right}.{a1}"), F.col(f"{right}.{a2}"))
        return (F.greatest(l1, l2) + d >= F.least(r1, r2)) & (F.greatest(r1, r2) + d >= F.least(l1, l2))

    return apart("x1", "x2") & apart("y1", "y2")


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Planar bearing in degrees from north, reference latitude = the first point."""
    lon1, lat1, lon2, lat2 = (_c(v) for v in (lon1, lat1, lon2, lat2))
    east = (lon2 - lon1) * F.cos(F.radians(lat1))
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)), F.lit(360.0))


def angle_between(a, b) -> Column:
    turn = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(turn, 360.0 - turn)


def turn_cosine(lon0, lat0, lon1, lat1, lon2, lat2) -> Column:
    """Cosine of the turn at the middle point in raw degrees; 1 if a side is degenerate."""
    lon0, lat0, lon1, lat1, lon2, lat2 = (_c(v) for v in (lon0, lat0, lon1, lat1, lon2, lat2))
    ux, uy, vx, vy = lon1 - lon0, lat1 - lat0, lon2 - lon1, lat2 - lat1
    norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(norm == 0, F.lit(1.0)).otherwise((ux * vx + uy * vy) / norm)


def path_length(path) -> Column:
    """Haversine length of an ``array<struct<lon,lat>>``."""
    path = _c(path)
    n = F.size(path)
    steps = F.zip_with(
        F.slice(path, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(path, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]),
    )
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d))


def drop_repeats(path) -> Column:
    """Remove coordinates equal to the one before them."""
    path = _c(path)
    return F.filter(path, lambda p, i: (i == 0) | (p != F.get(path, i - 1)))


def stitch(paths, only_when_touching: bool = True) -> Column:
    """Concatenate an ordered ``array<path>``; skip each later first coordinate
    always, or only when it equals the end reached so far."""
    paths = F.filter(_c(paths), lambda p: F.size(p) > 0)

    def add(acc, path):
        skip = (
            F.element_at(acc, -1) == F.element_at(path, 1)
            if only_when_touching
            else F.lit(True)
        )
        rest = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(F.size(acc) == 0, path).when(skip, F.concat(acc, rest)).otherwise(F.concat(acc, path))

    return F.aggregate(paths, F.array().cast(PATH_TYPE), add)


def ring_area(path) -> Column:
    """Absolute shoelace area of a ring in its own units."""
    path = _c(path)
    n = F.size(path)
    cross = F.zip_with(
        F.slice(path, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(path, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"],
    )
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2)


def ring_sides(path) -> Column:
    """Sides of a closed ring as ``array<struct<x1,y1,x2,y2>>``."""
    path = _c(path)
    n = F.size(path)
    return F.zip_with(
        F.slice(path, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(path, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
        ),
    )


def sides_contain(sides, lon, lat) -> Column:
    """Strictly inside by the even-odd rule over all sides of a multipolygon.

    A point on a side counts as outside, which one pass marks with a large number.
    """
    sides, lon, lat = _c(sides), _c(lon), _c(lat)
    on_side = 1 << 40

    def step(acc, s):
        run, rise = s["x2"] - s["x1"], s["y2"] - s["y1"]
        touches = (
            (run * (lat - s["y1"]) == rise * (lon - s["x1"]))
            & lon.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
            & lat.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
        )
        crosses = ((s["y1"] > lat) != (s["y2"] > lat)) & (lon < run * (lat - s["y1"]) / rise + s["x1"])
        return acc + F.when(touches, F.lit(on_side)).when(crosses, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    total = F.aggregate(sides, F.lit(0).cast("bigint"), step)
    return (total < on_side) & (total % 2 == 1)


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


# SQL bodies of the helpers that SQL users call by name; Catalyst inlines them.
SQL_FUNCTIONS = {
    "geo_haversine_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE)": (
        "DOUBLE",
        "2 * 6371000.0D * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "geo_bearing_deg(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE)": (
        "DOUBLE",
        "pmod(degrees(atan2((lon2 - lon1) * cos(radians(lat1)), lat2 - lat1)), 360.0D)",
    ),
    "geo_offset_lon(lon DOUBLE, lat DOUBLE, east_m DOUBLE)": (
        "DOUBLE",
        "lon + degrees(east_m / (6371000.0D * greatest(1e-6D, cos(radians(lat)))))",
    ),
    "geo_offset_lat(lat DOUBLE, north_m DOUBLE)": ("DOUBLE", "lat + degrees(north_m / 6371000.0D)"),
    "geo_path_length_m(path ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>)": (
        "DOUBLE",
        "aggregate(sequence(2, greatest(size(path), 2)), 0.0D, (acc, i) -> acc + coalesce(2 * 6371000.0D * asin(least(1.0D, sqrt("
        "pow(sin(radians(get(path, i - 1).lat - path[i - 2].lat) / 2), 2) + cos(radians(path[i - 2].lat)) * cos(radians(get(path, i - 1).lat))"
        " * pow(sin(radians(get(path, i - 1).lon - path[i - 2].lon) / 2), 2)))), 0.0D))",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Expose the geometry helpers to SQL users as temporary SQL functions."""
    for signature, (returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    return [signature.split("(")[0] for signature in SQL_FUNCTIONS]
