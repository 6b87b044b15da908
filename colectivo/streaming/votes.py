"""Vote and detour-confirmation streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import latest_by
from ..operators.votes import tallies

KEYS = ("route_edge_id", "device_id")


def latest_votes(ballots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The vote in force of each key that a micro-batch touches (update mode).

    ``ballots``: keys, vote, created_at. The later vote counts, of votes at one
    time the one whose text is greater. The state holds one vote a key.
    """
    last = ballots.groupBy(*keys).agg(F.max(F.struct("created_at", "vote")).alias("last"))
    return last.select(*keys, "last.vote", "last.created_at")


def append_changes(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each micro-batch under its number, so that a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current_tallies(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per edge from the changes that ``latest_votes`` gave, each key's last one."""
    return tallies(latest_by(changes.select(*keys, "vote", "created_at"), list(keys), [F.col("created_at"), F.col("vote")]), keys[0])


def confirmation_spells(confirms: DataFrame, days: int = 7, lateness: str = "1 day") -> DataFrame:
    """Spells of confirmations per detour, none of them a week apart, once the watermark has passed their end.

    ``confirms``: detour_id, at. A spell that ends means that the detour
    expired, and its state is dropped; a later confirmation opens another spell.
    """
    window = F.session_window("at", f"{days} days")
    return (
        confirms.withWatermark("at", lateness).groupBy("detour_id", window)
        .agg(F.count(F.lit(1)).alias("confirmed_count"), F.min("at").alias("first_confirmed_at"), F.max("at").alias("last_confirmed_at"))
        .select("detour_id", "first_confirmed_at", "last_confirmed_at", "confirmed_count")
    )


def detours_at(spells: DataFrame, now, days: int = 7) -> DataFrame:
    """All confirmations of each detour and whether it is live: confirmed within the last week."""
    sums = spells.groupBy("detour_id").agg(F.sum("confirmed_count").alias("confirmed_count"), F.max("last_confirmed_at").alias("last_confirmed_at"))
    return sums.withColumn(
        "status", F.when(F.col("last_confirmed_at") < now - F.expr(f"INTERVAL {days} DAYS"), "expired").otherwise("active")
    )
