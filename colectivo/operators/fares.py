"""Fare zones and fare statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import snapshot

# Degrees per cell of the zone index; polygon sides of an index that every task may hold (about 40 MB).
ZONE_CELL_DEG, BROADCAST_SIDES = 0.01, 500_000
ZONAL_TYPES = ("trufi", "taxi_trufi")


def zone_cell(value) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / ZONE_CELL_DEG).cast("bigint")


def zone_index(zones: DataFrame) -> DataFrame:
    """One row per grid cell with the zones whose bounding box meets it.

    Of a zone's sides a cell holds those that the even-odd rule can meet
    there: at the height of the cell, and not wholly to its left.
    """
    corners = F.flatten("rings")
    low = lambda axis: F.array_min(F.transform(corners, lambda p: p[axis]))
    high = lambda axis: F.array_max(F.transform(corners, lambda p: p[axis]))
    boxed = zones.select(
        "zone_id",
        low("lon").alias("w"), high("lon").alias("e"), low("lat").alias("s"), high("lat").alias("n"),
        F.flatten(F.transform("rings", geo.ring_sides)).alias("sides"),
    )
    span = lambda lo, hi: F.sequence(zone_cell(lo), zone_cell(hi))
    meets = lambda side: (
        F.col("cy").between(zone_cell(F.least(side["y1"], side["y2"])), zone_cell(F.greatest(side["y1"], side["y2"])))
        & (zone_cell(F.greatest(side["x1"], side["x2"])) >= F.col("cx"))
    )
    return (
        boxed.withColumn("cx", F.explode(span("w", "e")))
        .withColumn("cy", F.explode(span("s", "n")))
        .withColumn("sides", F.filter("sides", meets))
        .groupBy("cx", "cy")
        .agg(F.collect_list(F.struct("zone_id", "w", "e", "s", "n", "sides")).alias("candidates"))
    )


@dataclass(frozen=True)
class ZoneLookup:
    """The cell index of a zone table, written once, and whether its measured size lets every task hold it."""

    index: DataFrame
    small: bool


def zone_lookup(zones: DataFrame, most_sides: int = BROADCAST_SIDES) -> ZoneLookup:
    index = snapshot(zone_index(zones))
    sides = index.agg(F.sum(F.aggregate("candidates", F.lit(0).cast("bigint"), lambda n, z: n + F.size(z["sides"]) + 1))).first()[0] or 0
    return ZoneLookup(index, sides <= most_sides)


def resolve_zone(points: DataFrame, zones: DataFrame | ZoneLookup, lon: str, lat: str, out: str) -> DataFrame:
    """Add the least id of the zones strictly containing each point, else null.

    Rows probe the index where they are: an index of at most ``BROADCAST_SIDES``
    sides goes to every task, and no row of ``points`` moves. A larger one is
    joined by cell; cells that many rows ask are then split by adaptive
    execution, and rows without coordinates are dealt over keys of their own,
    which no cell has.
    """
    lookup = zones if isinstance(zones, ZoneLookup) else zone_lookup(zones)
    x, y = F.col(lon), F.col(lat)
    apart = -1 - (F.lit(1 << 40) + F.pmod(F.xxhash64(*points.columns), F.lit(4096)))
    cells = points.withColumns({"cx": F.coalesce(zone_cell(x), apart), "cy": F.coalesce(zone_cell(y), F.lit(0))})
    inside = F.filter(
        "candidates",
        lambda z: (z["w"] < x) & (x < z["e"]) & (z["s"] < y) & (y < z["n"]) & geo.sides_contain(z["sides"], x, y),
    )
    index = F.broadcast(lookup.index) if lookup.small else lookup.index
    return (
        cells.join(index, ["cx", "cy"], "left")
        .withColumn(out, F.array_min(F.transform(inside, lambda z: z["zone_id"])))
        .drop("cx", "cy", "candidates")
    )


def resolve_report_zones(reports: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones of both ends of each fare report; zones already known stay."""
    lookup, out = zone_lookup(zones), reports
    for end, name in (("boarding", "_b"), ("alighting", "_a")):
        out = resolve_zone(out, lookup, f"{end}_lon", f"{end}_lat", name)
    known = lambda name, found: F.coalesce(F.col(name), F.col(found)) if name in reports.columns else F.col(found)
    return out.withColumns(
        {"boarding_zone_id": known("boarding_zone_id", "_b"), "alighting_zone_id": known("alighting_zone_id", "_a")}
    ).drop("_b", "_a")


def resolution_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of the resolve step: reports looked at and ends filled."""
    missing = lambda df: df.agg(
        F.count_if(F.col("boarding_zone_id").isNull() | F.col("alighting_zone_id").isNull()).alias("open"),
        F.count_if(F.col("boarding_zone_id").isNull()).alias("boarding"),
        F.count_if(F.col("alighting_zone_id").isNull()).alias("alighting"),
    )
    b = missing(before).selectExpr("open AS checked", "boarding AS b0", "alighting AS a0")
    a = missing(after).selectExpr("open AS unresolved", "boarding AS b1", "alighting AS a1")
    return b.join(a, F.lit(True)).selectExpr(
        "checked", "b0 - b1 AS boarding_filled", "a0 - a1 AS alighting_filled", "unresolved"
    )


def median_amount(amount: str = "amount") -> Column:
    """Exact interpolated median, rounded half-up to centavos.

    ``percentile`` merges value counts map-side; fares have few distinct values,
    so its state stays small however many reports a line has.
    """
    return F.round(F.percentile(F.col(amount).cast("double"), F.lit(0.5)).cast("decimal(18,6)"), 2).cast("decimal(8,2)")


def line_medians(reports: DataFrame) -> DataFrame:
    return reports.groupBy("line_id").agg(median_amount().alias("amount"), F.count(F.lit(1)).alias("reports"))


def zone_matrix(reports: DataFrame) -> DataFrame:
    """Directional median and count per zone pair with both ends known."""
    return (
        reports.where("boarding_zone_id IS NOT NULL AND alighting_zone_id IS NOT NULL")
        .groupBy("line_id", "boarding_zone_id", "alighting_zone_id")
        .agg(median_amount().alias("amount"), F.count(F.lit(1)).alias("reports"))
    )


def mean_matrix(reports: DataFrame) -> DataFrame:
    return (
        reports.where("boarding_zone_id IS NOT NULL AND alighting_zone_id IS NOT NULL")
        .groupBy("boarding_zone_id", "alighting_zone_id")
        .agg(F.round(F.avg(F.col("amount").cast("double")), 2).alias("amount"), F.count(F.lit(1)).alias("reports"))
    )


def pair_estimates(reports: DataFrame) -> DataFrame:
    """Symmetric estimate: both directions of a zone pair pooled."""
    return (
        reports.where("boarding_zone_id IS NOT NULL AND alighting_zone_id IS NOT NULL")
        .groupBy(
            "line_id",
            F.least("boarding_zone_id", "alighting_zone_id").alias("zone_a"),
            F.greatest("boarding_zone_id", "alighting_zone_id").alias("zone_b"),
        )
        .agg(median_amount().alias("amount"), F.count(F.lit(1)).alias("reports"))
    )


def common_amounts(reports: DataFrame, top: int = 4) -> DataFrame:
    """The most reported amounts per line, count first, cheaper first on ties."""
    counts = reports.groupBy("line_id", "amount").agg(F.count(F.lit(1)).alias("reports"))
    w = Window.partitionBy("line_id").orderBy(F.desc("reports"), "amount")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def line_fare_summary(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """Flat or zonal fare per line; a zonal line without resolved pairs falls back to flat.

    Lines of unknown type count as flat here.
    """
    flat = line_medians(reports).selectExpr("line_id", "amount AS flat_amount", "reports AS flat_reports")
    span = zone_matrix(reports).groupBy("line_id").agg(
        F.min("amount").alias("min_pair"), F.max("amount").alias("max_pair"), F.sum("reports").alias("pair_reports"),
        F.count(F.lit(1)).alias("pairs"),
    )
    zonal = F.col("line_type").isin(*ZONAL_TYPES) & F.col("pairs").isNotNull()
    pick = lambda yes, no: F.when(zonal, F.col(yes)).otherwise(F.col(no))
    return lines.join(flat, "line_id", "left").join(span, "line_id", "left").select(
        "line_id",
        F.when(zonal, "zonal").otherwise("flat").alias("type"),
        pick("min_pair", "flat_amount").alias("min_amount"),
        pick("max_pair", "flat_amount").alias("max_amount"),
        F.coalesce(pick("pair_reports", "flat_reports"), F.lit(0)).alias("reports"),
    )


def leg_fares(legs: DataFrame, lines: DataFrame, reports: DataFrame) -> DataFrame:
    """Fare of bus legs (line_id, from_zone, to_zone): flat for micro, pair estimate otherwise."""
    flat = line_medians(reports).selectExpr("line_id", "amount AS flat_amount")
    pairs = pair_estimates(reports).selectExpr("line_id", "zone_a", "zone_b", "amount AS pair_amount")
    return (
        legs.join(lines.select("line_id", "line_type"), "line_id", "left")
        .withColumns({"zone_a": F.least("from_zone", "to_zone"), "zone_b": F.greatest("from_zone", "to_zone")})
        .join(flat, "line_id", "left")
        .join(pairs, ["line_id", "zone_a", "zone_b"], "left")
        .withColumn("fare", F.when(F.col("line_type") == "micro", F.col("flat_amount")).otherwise(F.col("pair_amount")))
        .drop("zone_a", "zone_b", "flat_amount", "pair_amount", "line_type")
    )


def with_zone_names(reports: DataFrame, zones: DataFrame, unknown: str | None = None) -> DataFrame:
    names = zones.select("zone_id", "name")
    out = reports.join(
        names.selectExpr("zone_id AS boarding_zone_id", "name AS boarding_zone"), "boarding_zone_id", "left"
    ).join(names.selectExpr("zone_id AS alighting_zone_id", "name AS alighting_zone"), "alighting_zone_id", "left")
    return out.fillna({"boarding_zone": unknown, "alighting_zone": unknown}) if unknown else out


def take_reports(incoming: DataFrame, lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Intake: only reports of known lines, zones resolved on the way in."""
    known = incoming.join(lines.select("line_id"), "line_id", "left_semi")
    return resolve_report_zones(known, zones)


def in_range(amount: str = "amount", points: tuple[tuple[str, str], ...] = (("boarding_lon", "boarding_lat"), ("alighting_lon", "alighting_lat"))) -> Column:
    """Accepted fares are positive and below 10 000; coordinates lie on the globe."""
    ok = (F.col(amount) > 0) & (F.col(amount) < 10_000)
    for lon, lat in points:
        ok = ok & F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    return ok
