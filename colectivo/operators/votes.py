"""Votes on edges, lines and descriptors: latest per voter, tallies, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Votes
from ..functions import scalar
from .ordered import latest_by


def upsert_votes(current: DataFrame | None, events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest vote per key over the stored votes and the new events."""
    rows = events if current is None else current.unionByName(events, allowMissingColumns=True)
    return latest_by(rows, keys, [F.col(c) for c in order])


def tallies(votes: DataFrame, *keys: str) -> DataFrame:
    """Approvals and rejections per key."""
    return votes.groupBy(*keys).agg(
        F.count_if(F.col("vote") == "approve").alias("votes_for"),
        F.count_if(F.col("vote") == "reject").alias("votes_against"),
    )


def voters_per_edge(votes: DataFrame, edge: str = "edge_id") -> DataFrame:
    """Distinct voters: two levels, so a hot edge is reduced before it meets one task."""
    return votes.select(edge, "device_id").distinct().groupBy(edge).agg(F.count(F.lit(1)).alias("voters"))


def voting_events(votes: DataFrame, edge: str = "edge_id") -> DataFrame:
    """One row per device, vote and second, with the edges voted on; newest first.

    A device votes on an edge once per second at most, so the list is bounded by
    the edges of a route.
    """
    return (
        votes.select("device_id", "vote", F.date_trunc("second", "created_at").alias("second"), edge)
        .groupBy("device_id", "vote", "second")
        .agg(F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_set(edge)).alias("edges"))
        .orderBy(F.desc("second"), "device_id", "vote")
    )


def _passes(cfg: Votes) -> Column:
    total = F.col("votes_for") + F.col("votes_against")
    return (total >= cfg.min_votes) & (F.col("votes_for") / total >= cfg.min_ratio)


def resolve_edges(edges: DataFrame, routes: DataFrame, now: Column, cfg: Votes = Votes()) -> DataFrame:
    """Confirm pending edges of live routes with enough approval.

    ``edges`` holds route_id, status, votes_for, votes_against. The result has
    the new status, confirmed_at and the flags ``checked`` and ``confirmed_now``.
    """
    live = routes.where("status <> 'superseded'").select("route_id", F.lit(True).alias("live"))
    out = edges.join(live, "route_id", "left")
    checked = (F.col("status") == "pending") & F.coalesce("live", F.lit(False))
    hit = checked & F.coalesce(_passes(cfg), F.lit(False))
    old_at = F.col("confirmed_at") if "confirmed_at" in edges.columns else F.lit(None).cast("timestamp")
    return out.select(
        *[c for c in edges.columns if c not in ("status", "confirmed_at")],
        F.when(hit, "confirmed").otherwise(F.col("status")).alias("status"),
        F.when(hit, now).otherwise(old_at).alias("confirmed_at"),
        checked.alias("checked"),
        hit.alias("confirmed_now"),
    )


def edge_stats(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count_if("checked").alias("checked"),
        F.count_if("confirmed_now").alias("confirmed"),
        F.count_if(F.col("checked") & ~F.col("confirmed_now")).alias("still_pending"),
    )


def resolve_routes(routes: DataFrame, edges: DataFrame, now: Column, cfg: Votes = Votes(), min_confirmed: int = 1) -> DataFrame:
    """Confirm pending routes whose share of confirmed edges is high enough."""
    counts = edges.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("status") == "confirmed").alias("n_confirmed")
    )
    out = routes.join(counts, "route_id", "left")
    pending = F.col("status") == "pending"
    enough = (F.col("n_confirmed") >= min_confirmed) & (F.col("n_confirmed") / F.col("n_edges") >= cfg.min_confirmed_share)
    outcome = (
        F.when(~pending, "not_pending")
        .when(F.col("n_edges").isNull(), "no_edges")
        .when(enough, "promoted")
        .otherwise("insufficient")
    )
    out = out.withColumn("outcome", outcome)
    old_at = F.col("last_compared_at") if "last_compared_at" in routes.columns else F.lit(None).cast("timestamp")
    return out.select(
        *[c for c in routes.columns if c not in ("status", "last_compared_at")],
        F.when(F.col("outcome") == "promoted", "confirmed").otherwise(F.col("status")).alias("status"),
        F.when(F.col("outcome") == "promoted", now).otherwise(old_at).alias("last_compared_at"),
        "outcome",
    )


def resolve_lines(lines: DataFrame, line_votes: DataFrame, cfg: Votes = Votes()) -> DataFrame:
    """Approve pending lines with enough familiarity votes."""
    out = lines.join(tallies(line_votes, "line_id"), "line_id", "left")
    hit = (F.col("status") == "pending") & F.coalesce(_passes(cfg), F.lit(False))
    return out.select(
        *[c for c in lines.columns if c != "status"],
        F.when(hit, "approved").otherwise(F.col("status")).alias("status"),
        hit.alias("approved_now"),
    )


def cast_votes(
    current: DataFrame, ballots: DataFrame, overlaps: DataFrame, trip_counts: DataFrame, cfg: Votes = Votes()
) -> DataFrame:
    """Spread each ballot over the edges the device's trips run along.

    ``ballots``: device_id, line_id, vote, created_at and optionally
    section_index; ``overlaps``: device_id, line_id, route_edge_id,
    section_index. Devices below the trip count are not heard. A repeated vote
    leaves one row, so counters derived by ``tallies`` never drift.
    """
    heard = ballots.join(
        trip_counts.where(F.col("trips") >= cfg.min_trips).select("device_id", "line_id"), ["device_id", "line_id"], "left_semi"
    )
    # All ballots of one device, line and section reach the same edges, so the latest stands for them before they are spread.
    same = ["device_id", "line_id", *(c for c in ("section_index",) if c in ballots.columns)]
    heard = latest_by(heard.select(*same, "vote", "created_at"), same, [F.col("created_at"), F.col("vote")])
    spread = heard.alias("b").join(overlaps.alias("o"), ["device_id", "line_id"])
    if "section_index" in ballots.columns:
        spread = spread.where("b.section_index IS NULL OR b.section_index = o.section_index")
    cast = spread.select("route_edge_id", "device_id", "vote", "created_at")
    return upsert_votes(current, cast, ["route_edge_id", "device_id"], ["created_at", "vote"])


def carry_votes(old_edges: DataFrame, new_edges: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move votes of an old route version to the matching edges of the new one.

    Both edge tables hold lineage (line_id, ramal_label), route_edge_id,
    sequence, edge_id, forward. The last old edge of a key wins. Returns new
    edges with counters and the votes with their new owner and a ``moved`` flag.
    """
    key = ["line_id", "ramal_label", "edge_id", "forward"]
    old = old_edges.where("edge_id IS NOT NULL").groupBy(*key).agg(
        F.max_by("route_edge_id", "sequence").alias("old_edge"),
    )
    # One new owner per old edge: the last new edge with the key, as later updates find no rows left.
    new = new_edges.where("edge_id IS NOT NULL").groupBy(*key).agg(F.min_by("route_edge_id", "sequence").alias("owner"))
    moves = old.join(new, key).select("old_edge", "owner")
    counts = tallies(votes.withColumnRenamed("route_edge_id", "old_edge"), "old_edge")
    carried = (
        new_edges.drop("votes_for", "votes_against")
        .join(old, key, "left")
        .join(counts, "old_edge", "left")
        .drop("old_edge")
        .fillna(0, ["votes_for", "votes_against"])
    )
    moved = votes.join(moves, votes["route_edge_id"] == moves["old_edge"], "left").select(
        *[F.coalesce("owner", "route_edge_id").alias(c) if c == "route_edge_id" else F.col(c) for c in votes.columns],
        F.col("owner").isNotNull().alias("moved"),
    )
    return carried, moved


def import_votes(previous: DataFrame, new_edges: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand the votes of a line's superseded routes to the first fragment of its import.

    ``previous``: line_id, route_id, route_edge_id, sequence, edge_id, forward of
    the superseded routes; ``new_edges``: the same with fragment_index. Edges
    match by road edge and direction. Of several previous routes with an edge
    all votes move, and the counters are those of the last route; of a device
    that voted on several of them the latest vote stays. Returns the new edges
    with counters and the votes with their new owner and a ``moved`` flag.
    """
    key = ["line_id", "edge_id", "forward"]
    old = previous.where("edge_id IS NOT NULL").groupBy(*key, "route_id").agg(F.max_by("route_edge_id", "sequence").alias("old_edge"))
    first = new_edges.where("edge_id IS NOT NULL AND fragment_index = 0")
    owner = first.groupBy(*key).agg(F.min_by("route_edge_id", "sequence").alias("owner"))
    moves = old.join(owner, key).select("old_edge", "owner")
    last = old.groupBy(*key).agg(F.max_by("old_edge", "route_id").alias("old_edge"))
    counts = last.join(tallies(votes.withColumnRenamed("route_edge_id", "old_edge"), "old_edge"), "old_edge").drop("old_edge")
    counted = new_edges.drop("votes_for", "votes_against").join(counts.withColumn("fragment_index", F.lit(0)), [*key, "fragment_index"], "left")
    moved = votes.join(moves, votes["route_edge_id"] == moves["old_edge"], "left").select(
        *[F.coalesce("owner", "route_edge_id").alias(c) if c == "route_edge_id" else F.col(c) for c in votes.columns], F.col("owner").isNotNull().alias("moved"),
    )
    rest = [c for c in moved.columns if c not in ("route_edge_id", "device_id")]
    one = moved.groupBy("route_edge_id", "device_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "vote")).alias("v"))
    return counted.fillna(0, ["votes_for", "votes_against"]), one.select("route_edge_id", "device_id", "v.*").select(*moved.columns)


def create_descriptors(requests: DataFrame) -> DataFrame:
    """Accept the first text per (route, normalised text); the rest are conflicts.

    ``requests``: request_id, route_id, text, device_id, created_at. Adds
    text_normalized, outcome (created / conflict / empty) and descriptor_id.
    """
    keyed = requests.withColumn("text_normalized", scalar.descriptor_key(F.col("text")))
    first = (
        keyed.where("text_normalized IS NOT NULL")
        .groupBy("route_id", "text_normalized")
        .agg(F.min_by("request_id", F.struct("created_at", "request_id")).alias("descriptor_id"))
    )
    return keyed.join(first, ["route_id", "text_normalized"], "left").withColumn(
        "outcome",
        F.when(F.col("text_normalized").isNull(), "empty")
        .when(F.col("request_id") == F.col("descriptor_id"), "created")
        .otherwise("conflict"),
    )


def descriptor_votes(created: DataFrame, actions: DataFrame) -> DataFrame:
    """Votes standing after all actions.

    ``created``: descriptor_id, device_id, created_at (the creator's implicit
    vote); ``actions``: descriptor_id, device_id, action up/down, created_at.
    Actions before the descriptor exists are ignored.
    """
    implicit = created.select("descriptor_id", "device_id", F.lit("up").alias("action"), "created_at")
    valid = actions.join(created.selectExpr("descriptor_id", "created_at AS born_at"), "descriptor_id").where(
        "created_at >= born_at"
    ).select("descriptor_id", "device_id", "action", "created_at")
    last = latest_by(implicit.union(valid), ["descriptor_id", "device_id"], [F.col("created_at"), F.col("action")])
    return last.where("action = 'up'").select("descriptor_id", "device_id", "created_at")


def descriptor_list(created: DataFrame, votes: DataFrame, device_id=None) -> DataFrame:
    """Descriptors with vote counts, most voted first, then oldest."""
    counts = votes.groupBy("descriptor_id").agg(
        F.count(F.lit(1)).alias("votes_count"),
        F.bool_or(F.col("device_id") == F.lit(device_id)).alias("voted_by_me"),
    )
    return (
        created.join(counts, "descriptor_id", "left")
        .withColumn("votes_count", F.coalesce("votes_count", F.lit(0)))
        .withColumn("voted_by_me", F.coalesce("voted_by_me", F.lit(False)))
        .orderBy("route_id", F.desc("votes_count"), "created_at", "descriptor_id")
    )
