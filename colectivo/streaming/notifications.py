"""Detour notification limiter: three single alerts, one summary, then silence for a day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

DAY_US = 24 * 3600 * 1_000_000
SINGLE_LIMIT = 3
#: Pairs are dealt to so many groups of state; fixed for the life of a stream's checkpoint.
BUCKETS = 1024
OUTPUT = "pair string, has_id boolean, event_id bigint, sent_us bigint, decision string"
STATE = "pairs array<string>, singles array<array<bigint>>, summaries array<array<bigint>>"


def decide(sent: int, singles: Sequence[int], summaries: Sequence[int]) -> tuple[str, list[int], list[int]]:
    """Decision for one alert and the sends of the last day after it (at most four)."""
    singles = [t for t in singles if t >= sent - DAY_US]
    summaries = [t for t in summaries if t >= sent - DAY_US]
    if summaries:
        return "skipped", singles, summaries
    if len(singles) < SINGLE_LIMIT:
        return "individual", [*singles, sent], summaries
    return "coalesced", singles, [sent]


def _limit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Decisions for one bucket of pairs; a call costs far more than an alert, so pairs share it."""
    sends = {} if not state.exists else {p: (list(s), list(m)) for p, s, m in zip(*state.get)}
    # The watermark is past a day after these sends, so no alert to come can meet them.
    over = state.getCurrentWatermarkMs() * 1000 - DAY_US
    if state.hasTimedOut:
        _keep(state, sends, over)
        return
    events = pd.concat(list(batches), ignore_index=True).sort_values(["sent_us", "has_id", "event_id"], ascending=[True, False, True])
    decisions = []
    for pair, sent in zip(events["pair"], events["sent_us"].to_numpy().tolist()):
        decision, singles, summaries = decide(int(sent), *sends.get(pair, ((), ())))
        sends[pair] = (singles, summaries)
        decisions.append(decision)
    _keep(state, sends, over)
    yield events.assign(decision=decisions)[["pair", "has_id", "event_id", "sent_us", "decision"]]


def _keep(state: GroupState, sends: dict, over: int) -> None:
    """Store what may still count, until a day after the last send of the bucket."""
    kept = [(p, s, m) for p, (s, m) in sends.items() if max([*s, *m], default=over - 1) >= over]
    if not kept:
        if state.exists:
            state.remove()
        return
    state.update(tuple(list(c) for c in zip(*kept)))
    quiet_ms = max(max([*s, *m]) for _, s, m in kept) // 1000 + DAY_US // 1000
    state.setTimeoutTimestamp(max(quiet_ms, state.getCurrentWatermarkMs()) + 1)


def limit_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Streaming decisions per (device, line). ``events``: device_id, line_id, event_id, sent_us.

    The state is at most three single sends and one summary per pair, dropped by
    event time a day after them. Pairs are dealt to ``buckets`` groups by a hash.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    timed = events.select(
        F.concat_ws("/", text("device_id"), text("line_id")).alias("pair"), F.col("event_id").isNotNull().alias("has_id"),
        F.coalesce("event_id", F.lit(0)).cast("bigint").alias("event_id"), "sent_us", F.timestamp_micros("sent_us").alias("at"),
    ).withWatermark("at", "1 hour")
    bucket = F.pmod(F.xxhash64("pair"), F.lit(buckets)).cast("int")
    out = timed.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_limit, OUTPUT, STATE, "append", "EventTimeTimeout")
    part = lambda i: F.split("pair", "/")[i].try_cast("bigint")
    return out.select(part(0).alias("device_id"), part(1).alias("line_id"), F.when(F.col("has_id"), F.col("event_id")).alias("event_id"), "sent_us", "decision")
