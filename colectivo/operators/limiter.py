"""Batch form of the notification limiter over a whole history of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros
from ..session import snapshot
from .loops import reach_by_doubling
from .ordered import number_rows, running_sum, with_neighbours

DAY_US = 24 * 3600 * 1_000_000
SINGLE_LIMIT = 3


def limit_history(events: DataFrame) -> DataFrame:
    """Decision for every alert (device_id, line_id, event_id, sent_at) as if it had come live.

    After a summary the next alert let through comes more than a day later, when
    all earlier sends have expired, so it starts afresh. From a fresh start at
    alert i everything goes out singly until the first alert k ≥ i+3 whose third
    predecessor is at most a day old; k is the summary, and the next fresh start
    is the first alert more than a day after k. Which alerts can be summaries
    and where they lead depends on times only, so starts are found by pointer
    doubling, and no pair's history is held in one task.
    """
    keys = ["device_id", "line_id"]
    rows = number_rows(events.withColumn("us", micros(F.col("sent_at"))), keys, ["us", "event_id"], F.to_date("sent_at"), "n")
    rows = with_neighbours(rows.select(*keys, "event_id", "us", "n"), keys, "n", ["us"], before=SINGLE_LIMIT, after=0)
    full = F.coalesce(F.col("us") - F.col(f"prev{SINGLE_LIMIT}_us") <= DAY_US, F.lit(False))
    rows = rows.withColumn("full", full).select(*keys, "event_id", "us", "n", "full")
    rows = snapshot(running_sum(rows, keys, "n", F.col("full").cast("bigint"), "full_upto"))
    # First alert more than a day later, from slices of a day with the next day copied in.
    own = F.floor(F.col("us") / DAY_US)
    sliced = rows.withColumn("_slice", F.explode(F.array(own, own - 1)))
    day = Window.partitionBy(*keys, "_slice").orderBy("us").rangeBetween(0, DAY_US)
    after = sliced.withColumn("resume", F.max("n").over(day) + 1).where((F.col("_slice") == own) & F.col("full"))
    summaries = snapshot(after.select(*keys, F.col("n").alias("summary"), "resume", (F.col("full_upto") - 1).alias("rank")))
    # The summary of a start at n is the first full alert at n+3 or later.
    ahead = with_neighbours(rows.select(*keys, "n", "full_upto"), keys, "n", ["full_upto"], before=0, after=SINGLE_LIMIT - 1)
    starts = ahead.select(*keys, "n", F.col(f"next{SINGLE_LIMIT - 1}_full_upto").alias("rank")).where("rank IS NOT NULL")
    ends = snapshot(starts.join(summaries, [*keys, "rank"]).select(*keys, "n", "summary", "resume"))
    last = rows.groupBy(*keys).agg(F.max("n").alias("last"))
    links = ends.join(last, keys).where("resume <= last").select(*keys, F.col("n").alias("node"), F.col("resume").alias("next"))
    first = rows.where("n = 0").select(*keys, F.col("n").alias("node"))
    reached = reach_by_doubling(links, first, keys).withColumnRenamed("node", "n")
    marked = rows.join(reached.withColumn("_start", F.lit(1)), [*keys, "n"], "left")
    marked = running_sum(marked, keys, "n", F.coalesce("_start", F.lit(0)), "episode")
    spans = marked.where("_start = 1").join(ends, [*keys, "n"], "left").select(*keys, "episode", "summary")
    out = marked.join(spans, [*keys, "episode"])
    decision = (
        F.when(F.col("summary").isNull() | (F.col("n") < F.col("summary")), "individual")
        .when(F.col("n") == F.col("summary"), "coalesced")
        .otherwise("skipped")
    )
    return out.select(*keys, "event_id", "us", decision.alias("decision"))
