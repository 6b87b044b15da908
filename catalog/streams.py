"""Streaming queries over the tables, run to their end with the available-now trigger."""

import uuid
from math import ceil

from pyspark.sql import functions as F

from catalog import query
from catalog.lifecycle import LIMIT
from colectivo.operators import cleaning
from colectivo.session import checkpoint_root, snapshot, state_on_disk
from colectivo.streaming import notifications, uploads
from colectivo.streaming import votes as vote_stream
from fixtures import Tables, with_tables


#: Rows of a file that a stream reads: a span of a large table comes in as many tasks as it fills.
FILE_ROWS = 250_000


def folder(t: Tables, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/colectivo-{name}-{uuid.uuid4().hex}"


def feed(t: Tables, df, at: str, build, sink=None, mode: str = "append", spans: int = 6, drop=()):
    """Send ``df`` through a stream in micro-batches by time, with a restart from its checkpoint half way.

    The table is read once and cut at quantiles of ``at`` into spans of two
    files each, or as many as give a file ``FILE_ROWS`` rows, and each span is a
    micro-batch. The query is stopped after half of the spans and
    started anew for the others, so its state crosses batches and runs.
    ``build`` makes the stream's result; it is written to files, which come
    back as a table, or goes to ``sink``, a function for single micro-batches.
    """
    source, state, out = (folder(t, name) for name in ("input", "state", "output"))
    rows = snapshot(df.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))))
    cuts, n = rows.agg(F.percentile_approx("_us", [i / spans for i in range(1, spans)], 10_000), F.count(F.lit(1))).first()
    files = max(2, ceil(n / spans / FILE_ROWS))
    low = None
    for i, high in enumerate([*cuts, None]):
        part = rows.where(F.col("_us") >= low) if low is not None else rows
        part = part.where(F.col("_us") < high) if high is not None else part
        part.drop("_us", *drop).repartition(files).write.mode("append").parquet(source)
        low = high
        if i + 1 in (spans // 2, spans):
            stream = build(t.spark.readStream.schema(df.drop(*drop).schema).option("maxFilesPerTrigger", files).parquet(source))
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
            writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", out)
            writer.start().awaitTermination()
    return None if sink else t.spark.read.schema(stream.schema).parquet(out)


def uploads_of(t: Tables):
    return t.trace_points.selectExpr("trace_id AS session_id", "cast(ts AS timestamp) AS ts", "lon", "lat")


def with_last(df, at: str, **values):
    """The table and one row long after all others, which moves the watermark past them."""
    late = df.agg((F.max(at) + F.expr("INTERVAL 1000 DAYS")).alias(at)).select(*(F.col(c) if c == at else F.lit(values.get(c)).cast(dict(df.dtypes)[c]).alias(c) for c in df.columns))
    return df.unionByName(late)


@query("x01_session_activity", with_tables("""SELECT session_id, sum(opens) AS windows, count(*) AS points FROM (SELECT trace_id AS session_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY trace_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM trace_points) GROUP BY 1""", "trace_points"))
def session_activity(t: Tables):
    """Sessions closed by silence, some of them cut by a micro-batch."""
    out = feed(t, with_last(uploads_of(t), "ts", session_id=-1), "ts", uploads.session_activity)
    return out.where("session_id >= 0").groupBy("session_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("points").alias("points"))


@query("x02_clean_on_end", with_tables("SELECT trace_id AS session_id, count(*) FILTER (WHERE type <> 'unmatched') AS at_most FROM matched_points WHERE trace_id % 9 > 0 GROUP BY 1", "matched_points"))
def clean_on_end(t: Tables):
    """Sessions that end in each micro-batch are cleaned in it, and only they."""
    ended = t.trace_points.groupBy("trace_id", "line_id").agg(F.max("ts").alias("ended_at")).selectExpr(
        "trace_id AS session_id", "line_id", "CASE WHEN trace_id % 9 = 0 THEN 'discarded' ELSE 'completed' END AS status", "cast(ended_at AS timestamp) AS ended_at")
    out = folder(t, "cleaned")

    def clean(ids):
        rows = t.matched_points.withColumnRenamed("trace_id", "session_id").join(ids, "session_id", "left_semi")
        return {"kept": rows.where("type <> 'unmatched'"), "points": cleaning.drop_spikes(rows, ["session_id"])}

    def write(results, batch_id):
        counts = results["kept"].groupBy("session_id").agg(F.count(F.lit(1)).alias("at_most"))
        counts.join(results["points"].select("session_id").distinct(), "session_id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    feed(t, ended, "ended_at", lambda stream: stream, uploads.ended_batches(clean, write))
    return t.spark.read.parquet(out).select("session_id", "at_most")


@query("x03_notification_stream", with_tables(f"WITH RECURSIVE {LIMIT} SELECT device_id, line_id, event_id, decision FROM s", "detour_events"))
def notification_stream(t: Tables):
    """Alert series that run over micro-batches, their counts kept in state."""
    events = t.detour_events.selectExpr("device_id", "line_id", "event_id", "unix_micros(cast(sent_at AS timestamp)) AS sent_us", "sent_at")
    return feed(t, events, "sent_at", notifications.limit_stream, drop=("sent_at",)).select("device_id", "line_id", "event_id", "decision")


@query("x04_vote_stream", with_tables("""SELECT route_edge_id, count(*) FILTER (WHERE vote = 'approve') AS votes_for, count(*) FILTER (WHERE vote = 'reject') AS votes_against FROM (
    SELECT edge_id AS route_edge_id, device_id, max_by(vote, (created_at, vote)) AS vote FROM edge_vote_events GROUP BY 1, 2) GROUP BY 1""", "edge_vote_events"))
def vote_events(t: Tables):
    """Votes changed in later micro-batches replace the earlier ones in the tallies."""
    events = t.edge_vote_events.selectExpr("edge_id AS route_edge_id", "device_id", "vote", "cast(created_at AS timestamp) AS created_at")
    path = folder(t, "votes")
    with state_on_disk(t.spark):  # a vote stays in the state for ever
        feed(t, events, "created_at", vote_stream.latest_votes, vote_stream.append_changes(path), mode="update")
    return vote_stream.current_tallies(t.spark.read.parquet(path)).select("route_edge_id", "votes_for", "votes_against")


@query("x05_detour_stream", "SELECT l_orderkey AS detour_id, count(*) AS confirmed_count, CASE WHEN max(l_shipdate) < TIMESTAMP '1998-06-01' - INTERVAL 7 DAY THEN 'expired' ELSE 'active' END AS status FROM lineitem GROUP BY 1")
def detour_stream(t: Tables):
    """Spells of confirmations leave the state a week after their last one; counts add up over a detour's spells."""
    confirms = t.raw("lineitem").selectExpr("l_orderkey AS detour_id", "cast(l_shipdate AS timestamp) AS at")
    spells = feed(t, with_last(confirms, "at", detour_id=-1), "at", vote_stream.confirmation_spells)
    now = F.to_timestamp(F.lit("1998-06-01 00:00:00"))
    return vote_stream.detours_at(spells.where("detour_id >= 0"), now).select("detour_id", "confirmed_count", "status")


@query("x06_drop_reuploads", with_tables("SELECT trace_id AS session_id, count(*) AS points FROM trace_points GROUP BY 1", "trace_points"))
def drop_reuploads(t: Tables):
    """Every point comes again half an hour later, often in another micro-batch, and comes out once."""
    first = uploads_of(t).withColumn("sent_at", F.col("ts"))
    again = first.withColumn("sent_at", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    out = feed(t, first.unionByName(again), "sent_at", uploads.drop_reuploads, drop=("sent_at",))
    return out.groupBy("session_id").agg(F.count(F.lit(1)).alias("points"))
