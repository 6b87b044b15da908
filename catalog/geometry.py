"""Scalar geometry and polyline queries."""

from pyspark.sql import functions as F

from catalog import query
from colectivo.functions import geo, scalar
from colectivo.operators import ordered, polyline as ops
from fixtures import Tables, hav, point_seg, with_tables

W = "WINDOW w AS (PARTITION BY trace_id ORDER BY point_index)"
PAIR = f"p AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM trace_points {W})"


def neighbours(t: Tables):
    return ordered.with_neighbours(t.trace_points, ["trace_id"], "point_index", ["lon", "lat"])


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("f01_haversine", with_tables(f"WITH {PAIR} SELECT trace_id, point_index, round({hav('plon', 'plat', 'lon', 'lat')}, 3) AS m FROM p", "trace_points"))
def haversine(t: Tables):
    return neighbours(t).select("trace_id", "point_index", F.round(geo.haversine("prev1_lon", "prev1_lat", "lon", "lat"), 3).alias("m"))


@query("f02_offset_point", with_tables("""SELECT trace_id, point_index, round(lon + degrees((event_id % 100) / (6371000.0 * greatest(1e-6, cos(radians(lat))))), 8) AS lon,
    round(lat + degrees((event_id % 37) / 6371000.0), 8) AS lat FROM trace_points""", "trace_points"))
def offset_point(t: Tables):
    lon, lat = geo.offset("lon", "lat", F.col("event_id") % 100, F.col("event_id") % 37)
    return t.trace_points.select("trace_id", "point_index", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("f03_unit_headings", with_tables(f"""WITH {PAIR}, v AS (SELECT trace_id, point_index, (coalesce(nlon, lon) - coalesce(plon, lon)) * cos(radians((coalesce(plat, lat) + coalesce(nlat, lat)) / 2)) AS e,
    coalesce(nlat, lat) - coalesce(plat, lat) AS n FROM p)
    SELECT trace_id, point_index, round(CASE WHEN sqrt(e*e + n*n) > 0 THEN e / sqrt(e*e + n*n) ELSE 1.0 END, 6) AS heading_e,
    round(CASE WHEN sqrt(e*e + n*n) > 0 THEN n / sqrt(e*e + n*n) ELSE 0.0 END, 6) AS heading_n FROM v""", "trace_points"))
def unit_headings(t: Tables):
    return rounded(ops.headings(t.trace_points, ["trace_id"]), heading_e=6, heading_n=6).select("trace_id", "point_index", "heading_e", "heading_n")


BEAR = "((degrees(atan2(({2} - {0}) * cos(radians({1})), {3} - {1})) + 720) % 360)"


@query("f04_bearing_and_turn", with_tables(f"""WITH {PAIR}, b AS (SELECT trace_id, point_index, {BEAR.format('plon', 'plat', 'lon', 'lat')} AS b1, {BEAR.format('lon', 'lat', 'nlon', 'nlat')} AS b2 FROM p
      WHERE plon IS NOT NULL AND nlon IS NOT NULL)
    SELECT trace_id, point_index, round(b1, 4) AS bearing, round(least(abs(b1 - b2) % 360, 360 - abs(b1 - b2) % 360), 4) AS turn FROM b""", "trace_points"))
def bearing_and_turn(t: Tables):
    b1 = geo.bearing("prev1_lon", "prev1_lat", "lon", "lat")
    b2 = geo.bearing("lon", "lat", "next1_lon", "next1_lat")
    return neighbours(t).where("prev1_lon IS NOT NULL AND next1_lon IS NOT NULL").select(
        "trace_id", "point_index", F.round(b1, 4).alias("bearing"), F.round(geo.angle_between(b1, b2), 4).alias("turn"))


@query("f05_projections", with_tables("""SELECT trace_id, point_index, round(lon * cos(radians(-17.39)) * 111320.0, 3) AS eq_x, round(lat * 110540.0, 3) AS band_y,
    round(radians(lon) * 6371000.0 * cos(radians(-17.39)), 3) AS rad_x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS merc_y FROM trace_points""", "trace_points"))
def projections(t: Tables):
    return t.trace_points.select(
        "trace_id", "point_index", F.round(geo.equirect("lon", "lat", -17.39)[0], 3).alias("eq_x"), F.round(geo.band("lon", "lat", -17.39)[1], 3).alias("band_y"),
        F.round(geo.radial("lon", "lat", -17.39)[0], 3).alias("rad_x"), F.round(geo.mercator("lon", "lat")[1], 3).alias("merc_y"))


@query("f06_point_to_chord", with_tables(f"""WITH {PAIR}, m AS (SELECT trace_id, point_index, lon * 1e5 AS px, lat * 1e5 AS py, plon * 1e5 AS ax, plat * 1e5 AS ay, nlon * 1e5 AS bx, nlat * 1e5 AS b_y FROM p)
    SELECT trace_id, point_index, round({point_seg('px', 'py', 'ax', 'ay', 'bx', 'b_y')}, 4) AS d FROM m WHERE ax IS NOT NULL AND bx IS NOT NULL""", "trace_points"))
def point_to_chord(t: Tables):
    k = lambda c: F.col(c) * 1e5
    d = geo.point_segment(k("lon"), k("lat"), k("prev1_lon"), k("prev1_lat"), k("next1_lon"), k("next1_lat"))
    return neighbours(t).where("prev1_lon IS NOT NULL AND next1_lon IS NOT NULL").select("trace_id", "point_index", F.round(d, 4).alias("d"))


@query("f08_path_length", with_tables(f"WITH {PAIR} SELECT trace_id, round(coalesce(sum({hav('plon', 'plat', 'lon', 'lat')}), 0), 3) AS m FROM p GROUP BY 1", "trace_points"))
def path_length(t: Tables):
    parts = ops.paths_in_parts(t.trace_points, ["trace_id"], "point_index")
    return parts.groupBy("trace_id").agg(F.round(F.sum(geo.path_length("path")), 3).alias("m"))


@query("f09_turn_cosine", with_tables(f"""WITH {PAIR} SELECT trace_id, point_index, round(CASE WHEN sqrt(pow(lon-plon,2)+pow(lat-plat,2)) * sqrt(pow(nlon-lon,2)+pow(nlat-lat,2)) = 0 THEN 1.0
    ELSE ((lon-plon)*(nlon-lon) + (lat-plat)*(nlat-lat)) / (sqrt(pow(lon-plon,2)+pow(lat-plat,2)) * sqrt(pow(nlon-lon,2)+pow(nlat-lat,2))) END, 6) AS c FROM p WHERE plon IS NOT NULL AND nlon IS NOT NULL""", "trace_points"))
def turn_cosine(t: Tables):
    return neighbours(t).where("prev1_lon IS NOT NULL AND next1_lon IS NOT NULL").select(
        "trace_id", "point_index", F.round(geo.turn_cosine("prev1_lon", "prev1_lat", "lon", "lat", "next1_lon", "next1_lat"), 6).alias("c"))


@query("f10_line_name_key", with_tables("SELECT line_id, trim(regexp_replace(strip_accents(lower(trim(name))), '^(linea|line|l\\.?)\\s*', '')) AS key FROM lines", "lines"))
def line_name_key(t: Tables):
    return t.lines.select("line_id", scalar.line_name_key(F.col("name")).alias("key"))


@query("f13_detour_confidence", with_tables("""WITH d AS (SELECT detour_id, confirmed_count, (epoch_us(TIMESTAMP '1998-06-01 12:00:00') - epoch_us(last_confirmed_at)) AS us FROM detours), e AS (SELECT detour_id, confirmed_count, CAST(floor(us / 86400000000.0) AS BIGINT) AS days FROM d)
    SELECT detour_id, days, CAST(greatest(0, least(100, round_even(100 * greatest(0.0, least(1.0, 1.0 - days / 14.0)) * least(1.0, 0.5 + 0.5 * ln(1 + greatest(0, confirmed_count - 1)) / ln(21.0)), 0))) AS INTEGER) AS confidence FROM e""", "detours"))
def detour_confidence(t: Tables):
    now = F.to_timestamp(F.lit("1998-06-01 12:00:00"))
    d = t.detours.withColumn("days", scalar.whole_days(now, F.col("last_confirmed_at")))
    return d.select("detour_id", "days", scalar.detour_confidence(F.col("days"), F.col("confirmed_count")).alias("confidence"))


@query("f14_edge_keys", with_tables("SELECT trace_id, seq, CAST(edge_id AS VARCHAR) || ':f' AS key, edge_id AS parsed FROM trace_edges", "trace_edges"))
def edge_keys(t: Tables):
    key = scalar.edge_key(F.col("edge_id"), F.col("forward"))
    return t.trace_edges.select("trace_id", "seq", key.alias("key"), scalar.edge_key_id(key).alias("parsed"))


@query("f16_label_family", with_tables("SELECT route_id, regexp_replace(ramal_label || CASE WHEN version = 1 THEN '.2' ELSE '' END, '\\.\\d+$', '') AS family FROM routes", "routes"))
def label_family(t: Tables):
    label = F.concat("ramal_label", F.when(F.col("version") == 1, ".2").otherwise(""))
    return t.routes.select("route_id", scalar.label_family(label).alias("family"))


CUM = f"""cum AS (SELECT *, sum(d) OVER (PARTITION BY trace_id ORDER BY point_index) AS cum FROM (SELECT *, coalesce({hav('plon', 'plat', 'lon', 'lat')}, 0) AS d FROM p)),
tot AS (SELECT trace_id, max(cum) AS total, max(point_index) AS last_idx FROM cum GROUP BY 1),
seg AS (SELECT c.trace_id, c.point_index, c.plon, c.plat, c.lon, c.lat, c.cum - c.d AS c0, c.cum AS c1, t.total, t.last_idx, epoch_us(c.ts) / 1000000.0 AS s1, c.ts FROM cum c JOIN tot t USING (trace_id))"""


@query("w07_arc_fraction", with_tables(f"WITH {PAIR}, {CUM} SELECT trace_id, point_index, round(c1, 3) AS cum, round(c1 / total, 6) AS fraction FROM seg", "trace_points"))
def arc_fraction(t: Tables):
    return rounded(ops.arc_fractions(t.trace_points, ["trace_id"]), cum=3, fraction=6).select("trace_id", "point_index", "cum", "fraction")


def at(target: str) -> str:
    """Interpolation of the first segment that reaches the target."""
    return f"""SELECT trace_id, k, round(min_by(plon + f * (lon - plon), point_index), 6) AS lon, round(min_by(plat + f * (lat - plat), point_index), 6) AS lat
      FROM (SELECT g.trace_id, g.k, s.point_index, s.plon, s.plat, s.lon, s.lat, greatest(0, least(1, (g.target - s.c0) / (s.c1 - s.c0))) AS f FROM ({target}) g
        JOIN seg s ON s.trace_id = g.trace_id AND s.point_index > 0 AND s.c1 + 1e-7 >= g.target) GROUP BY 1, 2"""


EVEN = at("""SELECT trace_id, unnest(generate_series(0, n - 1)) AS k, total * unnest(generate_series(0, n - 1)) / (n - 1) AS target
    FROM (SELECT trace_id, total, greatest(2, CAST(floor(total / 250.0) AS BIGINT) + 1) AS n FROM tot WHERE last_idx > 0)""")
STEP = at("""SELECT trace_id, unnest(generate_series(0, CAST(floor(total / 250.0) AS BIGINT))) AS k, unnest(generate_series(0, CAST(floor(total / 250.0) AS BIGINT))) * 250.0 AS target FROM tot WHERE last_idx > 0""")


@query("m08_resample_even", with_tables(f"WITH {PAIR}, {CUM} {EVEN}", "trace_points"))
def resample_even(t: Tables):
    return rounded(ops.resample_even(t.trace_points, ["trace_id"], "point_index", 250.0), lon=6, lat=6)


@query("m09_resample_step", with_tables(f"""WITH {PAIR}, {CUM} {STEP} UNION ALL SELECT trace_id, CAST(floor(total / 250.0) AS BIGINT) + 1, round(lon, 6), round(lat, 6)
    FROM seg WHERE point_index = last_idx AND total > floor(total / 250.0) * 250.0""", "trace_points"))
def resample_step(t: Tables):
    return rounded(ops.resample_step(t.trace_points, ["trace_id"], "point_index", 250.0), lon=6, lat=6)


@query("m10_resample_with_time", with_tables(f"""WITH {PAIR}, {CUM}, g AS ({STEP}), ser AS (SELECT trace_id, unnest(generate_series(0, CAST(floor(total / 250.0) AS BIGINT))) AS k FROM tot WHERE last_idx > 0),
    tt AS (SELECT s.trace_id, s.k, min_by(b.s0 + greatest(0, least(1, (s.k * 250.0 - b.c0) / (b.c1 - b.c0))) * (b.s1 - b.s0), b.point_index) AS s FROM ser s
      JOIN (SELECT *, lag(s1) OVER (PARTITION BY trace_id ORDER BY point_index) AS s0 FROM seg) b ON b.trace_id = s.trace_id AND b.point_index > 0 AND b.c1 + 1e-7 >= s.k * 250.0 GROUP BY 1, 2)
    SELECT g.trace_id, g.k, g.lon, g.lat, round(tt.s, 0) AS second FROM g JOIN tt USING (trace_id, k)""", "trace_points"))
def resample_with_time(t: Tables):
    timed = t.trace_points.withColumn("second", scalar.micros(F.col("ts")) / 1e6)
    return rounded(ops.resample_step(timed, ["trace_id"], "point_index", 250.0, keep_last=False, carry=["second"]), lon=6, lat=6, second=0)


@query("m11_resample_count", with_tables(f"""WITH {PAIR}, cum AS (SELECT *, sum(d) OVER (PARTITION BY trace_id ORDER BY point_index) AS cum FROM (SELECT *, coalesce(sqrt(pow(lon - plon, 2) + pow(lat - plat, 2)), 0) AS d FROM p)),
    tot AS (SELECT trace_id, max(cum) AS total, max(point_index) AS last_idx FROM cum GROUP BY 1),
    seg AS (SELECT trace_id, point_index, plon, plat, lon, lat, cum - d AS c0, cum AS c1 FROM cum)
    SELECT trace_id, k, lon, lat FROM ({at("SELECT trace_id, unnest(generate_series(0, 9)) AS k, total * unnest(generate_series(0, 9)) / 9 AS target FROM tot WHERE last_idx > 0").replace('1e-7', '1e-12')})""", "trace_points"))
def resample_count(t: Tables):
    return rounded(ops.resample_even(t.trace_points, ["trace_id"], "point_index", count=10, metric="degrees"), lon=6, lat=6)


@query("m12_simplify")
def simplify(t: Tables):
    kept = ops.simplify(t.trace_points, ["trace_id"], "point_index", 5e-5)
    return ops.simplify_stats(t.trace_points, kept, ["trace_id"])


@query("m13_drop_repeats", with_tables(f"""WITH c AS (SELECT trace_id, point_index, lon - lon % 0.002 AS lon, lat FROM (SELECT trace_id, point_index, round(lon, 3) AS lon, round(lat, 3) AS lat FROM trace_points)),
    d AS (SELECT *, lag(lon) OVER w AS pl, lag(lat) OVER w AS pt FROM (SELECT trace_id, point_index, floor(lon * 500) AS lon, floor(lat * 500) AS lat FROM trace_points) {W})
    SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY point_index) - 1 AS point_index, lon, lat FROM d WHERE pl IS NULL OR pl <> lon OR pt <> lat""", "trace_points"))
def drop_repeats(t: Tables):
    coarse = t.trace_points.selectExpr("trace_id", "point_index", "cast(floor(lon * 500) AS double) AS lon", "cast(floor(lat * 500) AS double) AS lat")
    return ops.drop_consecutive_repeats(coarse, ["trace_id"])


@query("m14_stitch_route", with_tables("""SELECT route_id, count(*) + 1 AS vertices, round(min(lon1), 6) AS first_lon, round(max(lon2), 6) AS last_lon FROM route_edges GROUP BY 1""", "route_edges"))
def stitch_route(t: Tables):
    paths = t.route_edges.selectExpr("route_id", "sequence", "array(named_struct('lon', lon1, 'lat', lat1), named_struct('lon', lon2, 'lat', lat2)) AS path")
    # Every route is bounded by its road edges.
    line = paths.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "path"))).alias("e")).select(
        "route_id", geo.stitch(F.transform("e", lambda e: e["path"]), only_when_touching=False).alias("path"))
    return line.select("route_id", F.size("path").alias("vertices"), F.round(F.element_at("path", 1)["lon"], 6).alias("first_lon"),
                       F.round(F.element_at("path", -1)["lon"], 6).alias("last_lon"))


ROUTE_SEG = """rs AS (SELECT line_id * 10 + lane AS line_id, sequence AS seg, lon1 * cos(radians(-17.39)) * 111320.0 AS x1, lat1 * 111320.0 AS y1, lon2 * cos(radians(-17.39)) * 111320.0 AS x2, lat2 * 111320.0 AS y2
    FROM route_edges)"""


def lane_segments(t: Tables):
    x1, y1 = geo.equirect("lon1", "lat1", -17.39)
    x2, y2 = geo.equirect("lon2", "lat2", -17.39)
    seg = t.route_edges.select(F.expr("line_id * 10 + lane AS line_id"), F.col("sequence").alias("seg"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    seg = seg.withColumn("len", geo.dist("x1", "y1", "x2", "y2"))
    return ordered.running_sum(seg, ["line_id"], "seg", F.col("len"), "_e").withColumn("pos", F.col("_e") - F.col("len")).drop("_e")


def flat_points(t: Tables):
    px, py = geo.equirect("lon", "lat", -17.39)
    return t.trace_points.select("trace_id", F.expr("line_id * 10 + trace_id % 3 AS line_id"), "point_index", px.alias("px"), py.alias("py"))


@query("f07_project_on_route", with_tables(f"""WITH {ROUTE_SEG}, pt AS (SELECT trace_id, line_id * 10 + trace_id % 3 AS line_id, point_index, lon * cos(radians(-17.39)) * 111320.0 AS px, lat * 111320.0 AS py FROM trace_points)
    SELECT trace_id, point_index, round(min(d), 3) AS offset_m FROM (SELECT p.trace_id, p.point_index, {point_seg('p.px', 'p.py', 'r.x1', 'r.y1', 'r.x2', 'r.y2')} AS d FROM pt p JOIN rs r USING (line_id)) WHERE d <= 60 GROUP BY 1, 2""",
    "trace_points", "route_edges"))
def project_on_route(t: Tables):
    near = ops.project(flat_points(t), lane_segments(t), ["line_id"], 60.0, ["trace_id", "point_index"])
    return near.select("trace_id", "point_index", F.round("offset_m", 3).alias("offset_m"))


@query("w11_detour_stretch", with_tables(f"""WITH {ROUTE_SEG}, pt AS (SELECT trace_id, line_id * 10 + trace_id % 3 AS line_id, point_index, lon * cos(radians(-17.39)) * 111320.0 AS px, (lat + CASE WHEN point_index BETWEEN 10 AND 20 THEN 0.002 ELSE 0 END) * 111320.0 AS py FROM trace_points),
    d AS (SELECT p.trace_id, p.point_index, min({point_seg('p.px', 'p.py', 'r.x1', 'r.y1', 'r.x2', 'r.y2')}) AS d FROM pt p JOIN rs r USING (line_id) GROUP BY 1, 2)
    SELECT trace_id, CASE WHEN min(CASE WHEN d > 50 THEN point_index END) IS NULL THEN 0 ELSE greatest(0, min(CASE WHEN d > 50 THEN point_index END) - 1) END AS start_index,
    CASE WHEN min(CASE WHEN d > 50 THEN point_index END) IS NULL THEN max(point_index) ELSE least(max(point_index), max(CASE WHEN d > 50 THEN point_index END) + 1) END AS end_index,
    min(CASE WHEN d > 50 THEN point_index END) IS NOT NULL AS diverges FROM d GROUP BY 1""", "trace_points", "route_edges"))
def detour_stretch(t: Tables):
    bent = t.trace_points.withColumn("lat", F.expr("lat + CASE WHEN point_index BETWEEN 10 AND 20 THEN 0.002D ELSE 0D END"))
    px, py = geo.equirect("lon", "lat", -17.39)
    path = bent.select("trace_id", F.expr("line_id * 10 + trace_id % 3 AS line_id"), "point_index", px.alias("px"), py.alias("py"))
    return ops.detour_stretch(path, lane_segments(t), ["trace_id"], ["line_id"], "point_index")


@query("v03_sql_functions", with_tables(f"""WITH {PAIR} SELECT trace_id, round(sum({hav('plon', 'plat', 'lon', 'lat')}), 2) AS m, round(max({BEAR.format('plon', 'plat', 'lon', 'lat')}), 3) AS bearing FROM p WHERE plon IS NOT NULL GROUP BY 1""", "trace_points"))
def sql_functions(t: Tables):
    geo.register_sql_functions(t.spark)
    neighbours(t).where("prev1_lon IS NOT NULL").createOrReplaceTempView("colectivo_steps")
    return t.spark.sql("""SELECT trace_id, round(sum(geo_haversine_m(prev1_lon, prev1_lat, lon, lat)), 2) AS m,
        round(max(geo_bearing_deg(prev1_lon, prev1_lat, lon, lat)), 3) AS bearing FROM colectivo_steps GROUP BY trace_id""")
