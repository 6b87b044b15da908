from pyspark.sql import functions as F

from catalog import query
from colectivo.functions import scalar
from colectivo.operators import schedules as ops
from fixtures import Tables, with_tables

STARTS = """starts AS (SELECT line_id, session_id, started_at, started_at - INTERVAL 4 HOUR AS local_at,
    CAST(started_at - INTERVAL 4 HOUR AS DATE) AS local_day,
    CASE isodow(started_at - INTERVAL 4 HOUR) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS day_bucket,
    hour(started_at - INTERVAL 4 HOUR) * 3600 + minute(started_at - INTERVAL 4 HOUR) * 60 + second(started_at - INTERVAL 4 HOUR) AS second_of_day
    FROM sessions WHERE status = 'completed')"""
GAPS = """gaps AS (SELECT *, (epoch_us(started_at) - epoch_us(lag(started_at) OVER (PARTITION BY line_id, local_day ORDER BY started_at, session_id))) / 60000000.0 AS gap_min,
    count(*) OVER (PARTITION BY line_id, local_day) AS in_day FROM starts)"""
CLOCK = "strftime(TIMESTAMP '2000-01-01' + to_seconds(CAST(round_even({0}, 0) AS BIGINT) % 86400), '%H:%M:%S')"
INFER = f"""{STARTS}, {GAPS},
hours AS (SELECT line_id, day_bucket, count(*) AS n_sessions, count(DISTINCT CASE WHEN in_day >= 5 THEN local_day END) AS n_valid_days,
    CASE WHEN count(*) >= 10 THEN {CLOCK.format('quantile_cont(second_of_day, 0.05)')} END AS service_start_at,
    CASE WHEN count(*) >= 10 THEN {CLOCK.format('quantile_cont(second_of_day, 0.95)')} END AS service_end_at FROM gaps GROUP BY 1, 2),
steady AS (SELECT line_id, day_bucket, count(*) AS n, median(gap_min) AS med, stddev_samp(gap_min) / avg(gap_min) AS cv
    FROM gaps WHERE in_day >= 5 AND gap_min > 0 AND gap_min <= 60 GROUP BY 1, 2)
"""


@query("f12_local_day_buckets", with_tables(
    f"WITH {STARTS} SELECT line_id, day_bucket, count(*) AS n, sum(second_of_day) AS seconds FROM starts GROUP BY 1, 2", "sessions"))
def local_day_buckets(t: Tables):
    return ops.local_starts(t.sessions).groupBy("line_id", "day_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("second_of_day").alias("seconds"))


@query("w01_start_gaps", with_tables(
    f"WITH {STARTS}, {GAPS} SELECT session_id, line_id, CAST(round(gap_min * 60000000) AS BIGINT) AS gap_us FROM gaps", "sessions"))
def start_gaps(t: Tables):
    return ops.start_gaps(ops.local_starts(t.sessions)).select("session_id", "line_id", F.round(F.col("gap_min") * 60_000_000).cast("bigint").alias("gap_us"))


@query("a10_service_hours", with_tables(
    f"WITH {INFER} SELECT line_id, day_bucket, n_sessions, service_start_at, service_end_at FROM hours", "sessions"))
def service_hours(t: Tables):
    return ops.service_hours(ops.local_starts(t.sessions))


@query("a11_headways", with_tables(f"""WITH {INFER} SELECT h.line_id, h.day_bucket, n_valid_days,
    CASE WHEN n >= 2 THEN round(cv, 6) END AS headway_cv, CASE WHEN n >= 2 AND cv < 0.5 THEN CAST(round_even(med, 0) AS INTEGER) END AS headway_min
    FROM hours h LEFT JOIN steady s ON h.line_id = s.line_id AND h.day_bucket = s.day_bucket WHERE n_valid_days > 0""", "sessions"))
def headways(t: Tables):
    return ops.headways(ops.local_starts(t.sessions)).withColumn("headway_cv", F.round("headway_cv", 6))


@query("infer_schedules", with_tables(f"""WITH {INFER} SELECT h.line_id, h.day_bucket, service_start_at, service_end_at,
    CASE WHEN n >= 2 AND cv < 0.5 THEN CAST(round_even(med, 0) AS INTEGER) END AS headway_min,
    CASE WHEN n >= 2 THEN round(cv, 6) END AS headway_cv, n_sessions, n_valid_days
    FROM hours h LEFT JOIN steady s ON h.line_id = s.line_id AND h.day_bucket = s.day_bucket
    WHERE h.line_id IN (SELECT line_id FROM lines WHERE status = 'approved')""", "lines", "sessions"))
def infer_schedules(t: Tables):
    return ops.infer_schedules(t.lines, t.sessions).withColumn("headway_cv", F.round("headway_cv", 6))


@query("l17_current_headway", with_tables(f"""WITH {INFER}, sched AS (SELECT h.line_id, h.day_bucket,
      CASE WHEN n >= 2 AND cv < 0.5 THEN CAST(round_even(med, 0) AS INTEGER) END AS headway_min
      FROM hours h LEFT JOIN steady s ON h.line_id = s.line_id AND h.day_bucket = s.day_bucket
      WHERE h.line_id IN (SELECT line_id FROM lines WHERE status = 'approved'))
    SELECT d.detour_id, d.line_id, s.headway_min FROM detours d LEFT JOIN sched s ON s.line_id = d.line_id
      AND s.day_bucket = CASE isodow(d.last_confirmed_at - INTERVAL 4 HOUR) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END""",
    "lines", "sessions", "detours"))
def current_headway(t: Tables):
    asked = t.detours.selectExpr("detour_id", "line_id", "last_confirmed_at AS at")
    return ops.current_headway(ops.infer_schedules(t.lines, t.sessions), asked).select("detour_id", "line_id", "headway_min")


@query("a25_schedules_by_line", with_tables(f"""WITH {INFER} SELECT h.line_id, l.name, string_agg(h.day_bucket || '=' || coalesce(service_start_at, '') , ',' ORDER BY h.day_bucket) AS buckets
    FROM hours h JOIN lines l ON l.line_id = h.line_id WHERE l.status = 'approved' GROUP BY 1, 2""", "lines", "sessions"))
def schedules_by_line(t: Tables):
    nested = ops.schedules_by_line(t.lines, ops.infer_schedules(t.lines, t.sessions))
    text = F.transform("buckets", lambda b: F.concat(b["day_bucket"], F.lit("="), F.coalesce(b["service_start_at"], F.lit(""))))
    return nested.select("line_id", "name", F.array_join(text, ",").alias("buckets"))


@query("l16_schedule_upsert", with_tables(f"""WITH {INFER} SELECT h.line_id, h.day_bucket, h.service_start_at, 'new' AS origin FROM hours h
      WHERE h.line_id IN (SELECT line_id FROM lines WHERE status = 'approved')
    UNION ALL SELECT line_id, 'holiday', '00:00:00', 'old' FROM lines WHERE status = 'approved'""", "lines", "sessions"))
def schedule_upsert(t: Tables):
    old = t.lines.where("status = 'approved'").selectExpr(
        "line_id", "explode(array('weekday', 'holiday')) AS day_bucket", "'00:00:00' AS service_start_at", "'old' AS origin")
    inferred = ops.infer_schedules(t.lines, t.sessions).select("line_id", "day_bucket", "service_start_at", F.lit("new").alias("origin"))
    also_weekday = inferred.where("day_bucket = 'weekday'").select("line_id")
    old = old.where("day_bucket = 'holiday'").union(old.where("day_bucket = 'weekday'").join(also_weekday, "line_id", "left_semi"))
    return ops.upsert_schedules(old, inferred)
