"""GeoJSON and GTFS in, GeoJSON and CSV out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.polyline import paths_in_parts

# Coordinates stay text until the geometry type is known, because nesting differs per type.
_GEOMETRY = "struct<type:string,coordinates:string>"
_FEATURE = f"struct<type:string,properties:map<string,string>,geometry:{_GEOMETRY}>"
_DOCUMENT = f"type string, coordinates string, properties map<string,string>, geometry {_GEOMETRY}, features array<{_FEATURE}>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file, name (stem) and parsed document."""
    docs = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]+)?$", 1)
    return docs.select("file", name.alias("name"), F.from_json("value", _DOCUMENT).alias("doc"))


def features(documents: DataFrame) -> DataFrame:
    """Features of FeatureCollection, Feature or bare geometry documents, in file order."""
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("map<string,string>").alias("properties"),
                    F.struct(F.col("doc.type").alias("type"), F.col("doc.coordinates").alias("coordinates")).alias("geometry"))
    single = F.struct(F.col("doc.type").alias("type"), F.col("doc.properties").alias("properties"), F.col("doc.geometry").alias("geometry"))
    listed = (
        F.when(F.col("doc.type") == "FeatureCollection", F.col("doc.features"))
        .when(F.col("doc.type") == "Feature", F.array(single))
        .otherwise(F.array(bare))
    )
    return documents.select("file", "name", F.posexplode(listed).alias("feature_index", "f")).select(
        "file", "name", "feature_index", F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry")
    )


def _points(raw):
    """Coordinate arrays as points; entries with fewer than two numbers are dropped."""
    return F.transform(
        F.filter(raw, lambda c: F.size(c) >= 2), lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))
    ).cast(geo.PATH_TYPE)


def line_strings(feats: DataFrame, multi: bool = True) -> DataFrame:
    """All LineString (and, with ``multi``, MultiLineString) parts: file, name, properties, fragment_index, path."""
    text, kind = F.col("geometry.coordinates"), F.col("geometry.type")
    one = F.array(_points(F.from_json(text, "array<array<double>>")))
    many = F.transform(F.from_json(text, "array<array<array<double>>>"), _points)
    parts = F.when(kind == "LineString", one)
    if multi:
        parts = parts.when(kind == "MultiLineString", many)
    rows = feats.withColumn("parts", parts).where("parts IS NOT NULL").select(
        "file", "name", "properties", "feature_index", F.posexplode("parts").alias("part", "path")
    ).where(F.size("path") > 0)
    # Files hold a few features each; numbering runs inside one file.

    order = Window.partitionBy("file").orderBy("feature_index", "part")
    return rows.withColumn("fragment_index", F.row_number().over(order) - 1).drop("feature_index", "part")


def read_routes(spark: SparkSession, path: str, every: bool = True, require: bool = False) -> DataFrame:
    """Route lines of a folder of GeoJSON files; with ``require`` a file without any line is an error."""
    docs = read_documents(spark, path)
    lines = line_strings(features(docs), multi=False)
    if require:
        empty = docs.join(lines.select("file").distinct(), "file", "left_anti").limit(1)
        if not empty.isEmpty():
            raise ValueError("a route file holds no LineString")
    return lines if every else lines.where("fragment_index = 0")


def primary_line(lines: DataFrame) -> DataFrame:
    """Longest part per file, the earlier one on ties."""
    return lines.withColumn("length_m", geo.path_length("path")).groupBy("file", "name").agg(
        F.max_by("path", F.struct("length_m", -F.col("fragment_index"))).alias("path"), F.max("length_m").alias("length_m")
    )


def ground_truth(feats: DataFrame) -> DataFrame:
    """First line of each file, a MultiLineString flattened into one path."""
    text, kind = F.col("geometry.coordinates"), F.col("geometry.type")
    flat = F.when(kind == "LineString", _points(F.from_json(text, "array<array<double>>"))).when(
        kind == "MultiLineString", F.flatten(F.transform(F.from_json(text, "array<array<array<double>>>"), _points))
    )
    return feats.withColumn("path", flat).where("path IS NOT NULL").groupBy("file", "name").agg(F.min_by("path", "feature_index").alias("path"))


def read_gtfs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """routes, trips (with row order) and shapes of a GTFS folder."""
    def csv(name, columns):
        return spark.read.option("header", True).csv(f"{root}/{name}.txt").select(*columns)

    routes = csv("routes", ["route_id", "route_short_name", "route_long_name"])
    # Files are read in order; the id grows with the row within and across splits.
    trips = csv("trips", ["route_id", "shape_id"]).withColumn("row", F.monotonically_increasing_id())
    shapes = csv("shapes", ["shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"]).select(
        "shape_id", F.col("shape_pt_sequence").cast("bigint").alias("shape_pt_sequence"),
        F.col("shape_pt_lon").cast("double").alias("lon"), F.col("shape_pt_lat").cast("double").alias("lat"),
    )
    return routes, trips, shapes


def gtfs_route_points(routes: DataFrame, trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Ordered shape points of every route; the last trip row decides the shape, routes without one fall away."""
    chosen = trips.where("shape_id IS NOT NULL").groupBy("route_id").agg(F.max_by("shape_id", "row").alias("shape_id"))
    return routes.join(chosen, "route_id").join(shapes, "shape_id").select(
        "route_id", "route_short_name", "route_long_name", "shape_id", "shape_pt_sequence", "lon", "lat"
    )


def feature_json(path: str = "path", **properties) -> Column:
    """A GeoJSON Feature of a path as text."""
    coords = F.transform(path, lambda p: F.array(p["lon"], p["lat"]))
    props = F.struct(*[v.alias(k) for k, v in properties.items()])
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), props.alias("properties"),
            F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"),
        )
    )


def route_features(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Route and edge features of a reconstruction: line_id, direction_group, ramal_label, feature."""
    route = routes.select(
        "line_id", "direction_group", "ramal_label",
        feature_json("path", kind=F.lit("route"), label=F.col("ramal_label"), direction_group=F.col("direction_group"), trace_count=F.col("trace_count")).alias("feature"),
    )
    edge = edges.where("path IS NOT NULL").select(
        "line_id", "direction_group", "ramal_label",
        feature_json(
            "path", kind=F.lit("edge"), label=F.col("ramal_label"), confidence=F.round("confidence", 3), inferred=F.col("bridge").isNotNull()
        ).alias("feature"),
    )
    return route.union(edge)


def write_features(feats: DataFrame, path: str, partition_by: Sequence[str] = ("line_id",)) -> None:
    """One feature per line of text, in folders per line."""
    feats.select(*partition_by, F.col("feature").alias("value")).write.mode("overwrite").partitionBy(*partition_by).text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics or run log as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def trace_layer(points: DataFrame, keys: Sequence[str], idx: str = "point_index") -> DataFrame:
    """Session or trip traces as features, long ones in several parts."""
    parts = paths_in_parts(points, keys, idx)
    props = {k: F.col(k) for k in [*keys, "part"]}
    return parts.where(F.size("path") >= 2).select(*keys, "part", F.size("path").alias("vertices"), feature_json("path", **props).alias("feature"))


def fare_point_layer(reports: DataFrame) -> DataFrame:
    """Two points per fare report, each carrying both ends."""
    ends = F.array(
        F.struct(F.lit("boarding").alias("kind"), F.col("boarding_lon").alias("lon"), F.col("boarding_lat").alias("lat")),
        F.struct(F.lit("alighting").alias("kind"), F.col("alighting_lon").alias("lon"), F.col("alighting_lat").alias("lat")),
    )
    return reports.withColumn("e", F.explode(ends)).where("e.lon IS NOT NULL AND e.lat IS NOT NULL").select(
        "report_id", "line_id", F.col("e.kind").alias("kind"), F.col("e.lon").alias("lon"), F.col("e.lat").alias("lat"),
        "amount", "boarding_lon", "boarding_lat", "alighting_lon", "alighting_lat",
    )


def variant_layer(routes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Live routes per variant with label, status, summary and feature. ``shapes``: route_id, path."""
    live = routes.where("status <> 'superseded'").join(shapes, "route_id")
    return live.select(
        "line_id", "route_id", "ramal_label", "status", "street_summary", F.size("path").alias("vertices"),
        feature_json("path", label=F.col("ramal_label"), status=F.col("status"), summary=F.col("street_summary")).alias("feature"),
    )


def labelled_traces(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Matched traces with the variant each belongs to. ``labels``: line_id, trace_id, ramal_label."""
    layer = trace_layer(points, ["line_id", "trace_id"])
    return layer.join(labels, ["line_id", "trace_id"], "left")
