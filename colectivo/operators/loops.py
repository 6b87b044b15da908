"""Iterative graph jobs that advance every group at once.

Each round is a join and an aggregation over all groups, cut by a snapshot. The
driver sees one counter per round, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import snapshot


def connected_components(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str = "node"
) -> DataFrame:
    """Component of each node = least node id in it.

    ``nodes``: keys + node; ``edges``: keys + src, dst in either orientation.
    Each round takes the least label among neighbours and then the label of the
    label, so a chain of n nodes needs about log2(n) rounds.
    """
    on = list(keys)
    both = snapshot(
        edges.select(*on, "src", "dst")
        .union(edges.select(*on, F.col("dst").alias("src"), F.col("src").alias("dst")))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )
    labels = snapshot(nodes.select(*on, F.col(node).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        hop = (
            both.join(labels.withColumnRenamed("node", "dst"), [*on, "dst"])
            .groupBy(*on, F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lowered = labels.join(hop, [*on, "node"], "left").select(
            *on, "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        parents = lowered.select(*on, F.col("node").alias("label"), F.col("label").alias("up"))
        step = snapshot(
            lowered.join(parents, [*on, "label"]).select(*on, "node", "was", F.least("label", "up").alias("label"))
        )
        labels = step.select(*on, "node", "label")
        if step.where(F.col("was") != F.col("label")).isEmpty():
            return labels.select(*on, F.col("node").alias(node), F.col("label").alias("component"))


def reach_by_doubling(links: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes met when following ``links`` (keys + node, next) from ``starts`` (keys + node).

    Pointer doubling: after k rounds everything within 2^k steps is known.
    """
    on = list(keys)
    jump = links.select(*on, "node", "next")
    reached = snapshot(starts.select(*on, "node").distinct())
    while True:
        fresh = (
            reached.join(jump, [*on, "node"])
            .select(*on, F.col("next").alias("node"))
            .distinct()
            .join(reached, [*on, "node"], "left_anti")
        )
        fresh = snapshot(fresh)
        if fresh.isEmpty():
            return reached
        reached = snapshot(reached.union(fresh))
        onward = jump.select(*on, F.col("node").alias("next"), F.col("next").alias("far"))
        jump = snapshot(jump.join(onward, [*on, "next"]).select(*on, "node", F.col("far").alias("next")))


def mutual_best(
    pairs: DataFrame,
    keys: Sequence[str],
    a: str,
    b: str,
    score: Sequence,
    shared_ids: bool = False,
) -> DataFrame:
    """One-to-one choice of pairs, best score first.

    A pair is taken when it is the best one left for both of its members, which
    picks what a scan in score order would pick. ``score`` columns sort
    ascending; ids break ties. With ``shared_ids`` both columns name the same
    kind of member, and a member taken on one side is gone from the other.
    """
    on = list(keys)
    tag = lambda side, col: F.concat(F.lit("n:" if shared_ids else f"{side}:"), F.col(col).cast("string"))
    left = snapshot(
        pairs.withColumns({"_rank": F.struct(*score, F.col(a), F.col(b)), "_na": tag("a", a), "_nb": tag("b", b)})
    )
    chosen = None
    while True:
        if left.isEmpty():
            return (chosen if chosen is not None else left).drop("_rank", "_na", "_nb")
        ends = left.select(*on, F.explode(F.array("_na", "_nb")).alias("_node"), "_rank")
        best = ends.groupBy(*on, "_node").agg(F.min("_rank").alias("_best"))
        side = lambda node, name: best.select(*on, F.col("_node").alias(node), F.col("_best").alias(name))
        taken = snapshot(
            left.join(side("_na", "_best_a"), [*on, "_na"])
            .join(side("_nb", "_best_b"), [*on, "_nb"])
            .where((F.col("_rank") == F.col("_best_a")) & (F.col("_rank") == F.col("_best_b")))
            .drop("_best_a", "_best_b")
        )
        chosen = taken if chosen is None else snapshot(chosen.unionByName(taken))
        used = taken.select(*on, F.explode(F.array("_na", "_nb")).alias("_na"))
        left = snapshot(
            left.join(used, [*on, "_na"], "left_anti").join(used.withColumnRenamed("_na", "_nb"), [*on, "_nb"], "left_anti")
        )
