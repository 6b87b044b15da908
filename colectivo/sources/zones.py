"""Fare-zone polygons from map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.loops import connected_components
from ..session import snapshot

SAME_PLACE_DEG = 1e-7


def way_paths(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Paths of ways. ``nodes``: node_id, lon, lat; ``ways``: way_id, node_ids (bounded by the map format)."""
    rows = ways.select("way_id", F.posexplode("node_ids").alias("i", "node_id")).join(nodes, "node_id")
    return rows.groupBy("way_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("path")
    ).where(F.size("path") >= 2)


def outer_rings(relations: DataFrame, paths: DataFrame) -> DataFrame:
    """Rings of each zone from its outer ways, joined end to end.

    ``relations``: zone key, name, members (array of struct<type, ref, role>).
    A ring starts at its least way and takes the way meeting its end, turned as
    needed; a chain that stays open goes on at its other end, and the ways left
    over start further rings. Rings of at least four points are closed.
    """
    members = relations.select("relation_id", "name", F.explode("members").alias("m")).where(
        "m.type = 'way' AND coalesce(m.role, '') IN ('outer', '')"
    ).select("relation_id", "name", F.col("m.ref").alias("way_id"))
    pieces = snapshot(members.join(paths, "way_id").select("relation_id", "name", "way_id", "path").distinct())
    snap = lambda p: F.concat_ws(",", F.round(p["lon"] / SAME_PLACE_DEG).cast("bigint"), F.round(p["lat"] / SAME_PLACE_DEG).cast("bigint"))
    ends = pieces.select("relation_id", "way_id", F.explode(F.array(snap(F.element_at("path", 1)), snap(F.element_at("path", -1)))).alias("spot"))
    touch = ends.groupBy("relation_id", "spot").agg(F.min("way_id").alias("dst"))
    links = ends.join(touch, ["relation_id", "spot"]).select("relation_id", F.col("way_id").alias("src"), "dst")
    part = connected_components(pieces, links, ["relation_id"], "way_id")
    left = snapshot(pieces.join(part, ["relation_id", "way_id"]))
    key = ["relation_id", "component"]
    rings = snapshot(left.where("way_id = component").select(*key, "name", "path", F.lit(False).alias("turned")))
    left = snapshot(left.where("way_id <> component").select(*key, "name", "way_id", "path"))
    shut = snap(F.element_at("path", 1)) == snap(F.element_at("path", -1))
    done = snapshot(rings.limit(0))
    while not rings.isEmpty():
        tips = rings.where(~shut).select(*key, snap(F.element_at("path", -1)).alias("tip"))
        both = left.select(*key, "way_id", F.col("path").alias("next")).union(left.select(*key, "way_id", F.reverse("path").alias("next")))
        hits = both.withColumn("tip", snap(F.element_at("next", 1))).join(tips, [*key, "tip"])
        pick = snapshot(hits.groupBy(*key).agg(F.min(F.struct("way_id", "next")).alias("p")).select(*key, "p.way_id", "p.next"))
        if not pick.isEmpty():
            tail = F.slice("next", 2, F.size("next") - 1)
            grown = F.when(F.col("next").isNotNull(), F.concat("path", tail)).otherwise(F.col("path"))
            rings = snapshot(rings.join(pick.select(*key, "next"), key, "left").select(*key, "name", grown.alias("path"), "turned"))
            left = snapshot(left.join(pick.select(*key, "way_id"), [*key, "way_id"], "left_anti"))
            continue
        # Nothing fits any end: open chains go on at their other end, the rest is done and a new ring begins with the least way left.
        over = snapshot(rings.where(shut | F.col("turned")))
        done = snapshot(done.unionByName(over))
        turn = rings.where(~(shut | F.col("turned"))).select(*key, "name", F.reverse("path").alias("path"), F.lit(True).alias("turned"))
        seed = left.join(over.select(*key), key, "left_semi").groupBy(*key).agg(F.min(F.struct("way_id", "name", "path")).alias("s"))
        seed = snapshot(seed.select(*key, "s.way_id", "s.name", "s.path"))
        rings = snapshot(turn.unionByName(seed.select(*key, "name", "path", F.lit(False).alias("turned"))))
        left = snapshot(left.join(seed.select(*key, "way_id"), [*key, "way_id"], "left_anti"))
    rings = done.drop("turned")
    closed = F.when(F.element_at("path", 1) == F.element_at("path", -1), F.col("path")).otherwise(F.concat("path", F.slice("path", 1, 1)))
    return rings.where(F.size("path") >= 4).withColumn("path", closed).where(geo.ring_area("path") > 0)


def zones_from_elements(relations: DataFrame, paths: DataFrame) -> DataFrame:
    """One zone per name with all its valid rings."""
    return outer_rings(relations, paths).groupBy("name").agg(F.collect_list("path").alias("rings"))


def upsert_zones(current: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace zones of the same name, add new ones; returns zones and created/updated counts."""
    both = current.select("name", "zone_id", F.col("rings").alias("old")).join(fresh.select("name", F.col("rings").alias("new")), "name", "full")
    merged = both.select(F.coalesce(F.col("zone_id").cast("string"), F.concat(F.lit("zone-"), F.col("name"))).alias("zone_id"), "name", F.coalesce("new", "old").alias("rings"))
    stats = both.agg(
        F.count_if(F.col("old").isNull()).alias("created"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("updated")
    )
    return merged, stats
