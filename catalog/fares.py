from pyspark.sql import functions as F

from catalog import query
from colectivo.operators import fares as ops
from fixtures import Tables, with_tables

MEDIAN = "CAST(round(CAST(quantile_cont(CAST(amount AS DOUBLE), 0.5) AS DECIMAL(18,6)), 2) AS DOUBLE)"
BOTH = "boarding_zone_id IS NOT NULL AND alighting_zone_id IS NOT NULL"


def zoned(t: Tables):
    return ops.resolve_report_zones(t.fare_reports, t.zones)


def amount(df):
    return df.withColumn("amount", F.col("amount").cast("double"))


@query("j09_point_in_zone", with_tables("SELECT report_id, boarding_zone_id, alighting_zone_id FROM zoned_reports", "zoned_reports"))
def point_in_zone(t: Tables):
    return zoned(t).select("report_id", "boarding_zone_id", "alighting_zone_id")


@query("a04_line_median_fare", with_tables(
    f"SELECT line_id, {MEDIAN} AS amount, count(*) AS reports FROM fare_reports GROUP BY 1", "fare_reports"))
def line_median(t: Tables):
    return amount(ops.line_medians(t.fare_reports))


@query("a05_zone_fare_matrix", with_tables(
    f"SELECT line_id, boarding_zone_id, alighting_zone_id, {MEDIAN} AS amount, count(*) AS reports FROM zoned_reports WHERE {BOTH} GROUP BY 1, 2, 3 ORDER BY reports DESC",
    "zoned_reports"))
def zone_matrix(t: Tables):
    return amount(ops.zone_matrix(zoned(t))).orderBy(F.desc("reports"))


SUMMARY = f"""flat AS (SELECT line_id, {MEDIAN} AS amount, count(*) AS reports FROM fare_reports GROUP BY 1),
    pairs AS (SELECT line_id, boarding_zone_id, alighting_zone_id, {MEDIAN} AS amount, count(*) AS reports FROM zoned_reports WHERE {BOTH} GROUP BY 1, 2, 3),
    span AS (SELECT line_id, min(amount) AS lo, max(amount) AS hi, sum(reports) AS reports FROM pairs GROUP BY 1)"""


@query("a06_line_fare_range", with_tables(f"WITH {SUMMARY} SELECT line_id, lo AS min_amount, hi AS max_amount FROM span", "zoned_reports"))
def fare_range(t: Tables):
    return ops.zone_matrix(zoned(t)).groupBy("line_id").agg(
        F.min("amount").cast("double").alias("min_amount"), F.max("amount").cast("double").alias("max_amount"))


@query("a07_pair_estimates", with_tables(f"""SELECT line_id, least(boarding_zone_id, alighting_zone_id) AS zone_a,
    greatest(boarding_zone_id, alighting_zone_id) AS zone_b, {MEDIAN} AS amount, count(*) AS reports FROM zoned_reports WHERE {BOTH} GROUP BY 1, 2, 3""",
    "zoned_reports"))
def pair_estimates(t: Tables):
    return amount(ops.pair_estimates(zoned(t)))


@query("a08_mean_fare_matrix", with_tables(f"""SELECT boarding_zone_id, alighting_zone_id, round(avg(CAST(amount AS DOUBLE)), 2) AS amount,
    count(*) AS reports FROM zoned_reports WHERE {BOTH} GROUP BY 1, 2""", "zoned_reports"))
def mean_matrix(t: Tables):
    return ops.mean_matrix(zoned(t))


@query("a09_common_amounts", with_tables("""SELECT line_id, CAST(amount AS DOUBLE) AS amount, reports, place FROM (
    SELECT line_id, amount, count(*) AS reports, row_number() OVER (PARTITION BY line_id ORDER BY count(*) DESC, amount) AS place
    FROM fare_reports GROUP BY 1, 2) WHERE place <= 4""", "fare_reports"))
def common_amounts(t: Tables):
    return amount(ops.common_amounts(t.fare_reports))


@query("l15_line_fare_summary", with_tables(f"""WITH {SUMMARY} SELECT l.line_id,
    CASE WHEN l.line_type <> 'micro' AND s.line_id IS NOT NULL THEN 'zonal' ELSE 'flat' END AS type,
    CASE WHEN l.line_type <> 'micro' AND s.line_id IS NOT NULL THEN s.lo ELSE f.amount END AS min_amount,
    CASE WHEN l.line_type <> 'micro' AND s.line_id IS NOT NULL THEN s.hi ELSE f.amount END AS max_amount,
    coalesce(CASE WHEN l.line_type <> 'micro' AND s.line_id IS NOT NULL THEN CAST(s.reports AS BIGINT) ELSE f.reports END, 0) AS reports
    FROM lines l LEFT JOIN flat f ON f.line_id = l.line_id LEFT JOIN span s ON s.line_id = l.line_id""", "lines", "zoned_reports"))
def fare_summary(t: Tables):
    out = ops.line_fare_summary(t.lines, zoned(t))
    return out.withColumns({c: F.col(c).cast("double") for c in ("min_amount", "max_amount")})


@query("j16_report_zone_names", with_tables("""SELECT report_id, coalesce(b.name, 'Unknown') AS boarding_zone, coalesce(a.name, 'Unknown') AS alighting_zone
    FROM zoned_reports r LEFT JOIN zones b ON b.zone_id = boarding_zone_id LEFT JOIN zones a ON a.zone_id = alighting_zone_id""", "zoned_reports"))
def zone_names(t: Tables):
    return ops.with_zone_names(zoned(t), t.zones, "Unknown").select("report_id", "boarding_zone", "alighting_zone")


HALF = "CASE WHEN line_id % 2 = 0 THEN boarding_zone_id END"


@query("l14_resolve_fare_zones", with_tables(f"""SELECT count(*) FILTER (WHERE {HALF} IS NULL OR alighting_zone_id IS NULL OR true) AS checked,
    count(boarding_zone_id) - count({HALF}) AS boarding_filled, count(alighting_zone_id) AS alighting_filled,
    count(*) FILTER (WHERE boarding_zone_id IS NULL OR alighting_zone_id IS NULL) AS unresolved FROM zoned_reports""", "zoned_reports"))
def resolve_zones(t: Tables):
    half = zoned(t).withColumn("boarding_zone_id", F.expr(HALF)).withColumn("alighting_zone_id", F.lit(None).cast("bigint"))
    return ops.resolution_stats(half, ops.resolve_report_zones(half, t.zones))


@query("l23_fare_report_intake", with_tables("""SELECT r.line_id, count(*) AS reports, count(boarding_zone_id) AS with_boarding, count(alighting_zone_id) AS with_alighting
    FROM zoned_reports r WHERE r.line_id IN (SELECT line_id FROM lines WHERE status <> 'draft') GROUP BY 1""", "lines", "zoned_reports"))
def report_intake(t: Tables):
    taken = ops.take_reports(t.fare_reports, t.lines.where("status <> 'draft'"), t.zones)
    return taken.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("reports"), F.count("boarding_zone_id").alias("with_boarding"),
        F.count("alighting_zone_id").alias("with_alighting"))


@query("f17_valid_reports", with_tables("""SELECT line_id, count(*) AS n FROM fare_reports WHERE amount > 1.5 AND amount < 10000
    AND boarding_lon BETWEEN -180 AND 180 AND boarding_lat BETWEEN -90 AND 90 GROUP BY 1""", "fare_reports"))
def valid_reports(t: Tables):
    return t.fare_reports.where(ops.in_range() & (F.col("amount") > 1.5)).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
