"""Edge-sequence operators: supports, beam search, noise removal, overlap assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import snapshot
from .ordered import with_neighbours
from .polyline import renumber


def occurrence_counts(edges: DataFrame, group: Sequence[str], node: str = "node", seq: str = "seq", distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Weights of edges and of consecutive pairs: occurrences, or distinct traces."""
    group = list(group)
    linked = with_neighbours(edges, [*group, "trace_id"], seq, [node], before=0, after=1)
    nodes = linked.select(*group, "trace_id", F.col(node).alias("node"))
    pairs = linked.where(f"next1_{node} IS NOT NULL").select(*group, "trace_id", F.col(node).alias("u"), F.col(f"next1_{node}").alias("v"))
    if distinct:
        nodes, pairs = nodes.distinct(), pairs.distinct()
    return nodes.groupBy(*group, "node").agg(F.count(F.lit(1)).alias("weight")), pairs.groupBy(*group, "u", "v").agg(F.count(F.lit(1)).alias("weight"))


def beam_search(
    nodes: DataFrame, pairs: DataFrame, group: Sequence[str], width: int = 8, starts: int = 5, pair_weight: float = 2.0, max_rounds: int = 100_000, hops_per_cut: int = 4
) -> DataFrame:
    """Best-scoring simple path per group: group, score, path.

    Score = node weights + pair_weight · pair weights. Starts are the heaviest
    nodes (then out−in, out); each hop keeps the best ``width`` paths per group.
    The beam is ``width`` rows per group, so each cut writes next to nothing.
    """
    on = list(group)
    outs = pairs.groupBy(*on, F.col("u").alias("node")).agg(F.sum("weight").alias("o"))
    ins = pairs.groupBy(*on, F.col("v").alias("node")).agg(F.sum("weight").alias("i"))
    ranked = nodes.join(outs, [*on, "node"], "left").join(ins, [*on, "node"], "left").fillna(0, ["o", "i"])
    first = Window.partitionBy(*on).orderBy(F.desc("weight"), F.desc(F.col("o") - F.col("i")), F.desc("o"), "node")
    beam = ranked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= min(starts, width)).select(
        *on, F.col("weight").cast("double").alias("score"), F.array("node").alias("path")
    )
    steps = snapshot(
        pairs.select(*on, "u", F.col("v").alias("node"), F.col("weight").alias("pw")).join(nodes, [*on, "node"])
        .select(*on, "u", "node", (F.col("weight") + pair_weight * F.col("pw")).cast("double").alias("gain"))
    )
    order = Window.partitionBy(*on).orderBy(F.desc("score"), "path")
    top = lambda df, n: df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    beam = snapshot(beam)
    best = snapshot(top(beam, 1))
    for _ in range(0, max_rounds, hops_per_cut):
        seen, live = [best], beam
        for _ in range(hops_per_cut):
            grown = live.withColumn("u", F.element_at("path", -1)).join(steps, [*on, "u"]).where(~F.array_contains("path", F.col("node"))).select(
                *on, (F.col("score") + F.col("gain")).alias("score"), F.concat("path", F.array("node")).alias("path")
            )
            live = top(grown, width)
            seen.append(live)
        joined = seen[0]
        for i, part in enumerate(seen[1:]):
            joined = joined.withColumn("_hop", F.lit(0)).unionByName(part.withColumn("_hop", F.lit(i + 1))) if "_hop" not in joined.columns else joined.unionByName(part.withColumn("_hop", F.lit(i + 1)))
        joined = snapshot(joined)
        best = snapshot(top(joined.drop("_hop"), 1))
        beam = joined.where(F.col("_hop") == hops_per_cut).drop("_hop")
        if beam.isEmpty():
            return best
    raise RuntimeError("beam search did not end")


def canonical_sequences(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Undirected edge ids per trace in the lexicographically smaller orientation.

    Ids compare as text, element by element. A trip's edges are bounded by the
    trip, so its orientation is decided on one array: group, trace_id, ids,
    reversed.
    """
    rows = edges.groupBy(*group, "trace_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("edge_id").cast("string").alias("id")))), lambda s: s["id"]).alias("ids")
    )
    back = F.reverse("ids")
    return rows.select(*group, "trace_id", F.least("ids", back).alias("ids"), (back < F.col("ids")).alias("reversed"))


def support_threshold(n_traces: Column, share: float = 0.34, explicit: int = 0) -> Column:
    return F.lit(max(1, explicit)) if explicit > 0 else F.greatest(F.lit(1), F.ceil(n_traces * share)).cast("bigint")


def drop_internal_noise(edges: DataFrame, group: Sequence[str], share: float = 0.34, noise: int = 1) -> DataFrame:
    """Remove weakly backed inner edges that a well-backed pair skips.

    An inner edge goes when its own support is low, the pair of its neighbours
    reaches the pair threshold, and that pair beats both pairs through it.
    Supports stay those of the input. Of adjacent candidates the first goes in a
    round and the rest are judged again, as a left-to-right scan would.
    """
    group = list(group)
    trace = [*group, "trace_id"]
    rows = snapshot(edges.select(*trace, "seq", "node"))
    weight, pair = occurrence_counts(rows, group, distinct=True)
    n = rows.select(*trace).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    limits = n.select(*group, support_threshold(F.col("n"), share).alias("need"))
    weight, pair = snapshot(weight.withColumnRenamed("weight", "w")), snapshot(pair)
    of = lambda a, b, name: pair.select(*group, F.col("u").alias(a), F.col("v").alias(b), F.col("weight").alias(name))
    while True:
        near = with_neighbours(rows, trace, "seq", ["node"])
        inner = near.where("prev1_node IS NOT NULL AND next1_node IS NOT NULL").join(weight, [*group, "node"]).join(limits, group)
        low = inner.where((F.col("w") < F.col("need")) | (F.col("w") <= noise))
        judged = (
            low.join(of("prev1_node", "next1_node", "skip"), [*group, "prev1_node", "next1_node"])
            .where("skip >= need")
            .join(of("prev1_node", "node", "left"), [*group, "prev1_node", "node"], "left")
            .join(of("node", "next1_node", "right"), [*group, "node", "next1_node"], "left")
            .where("coalesce(left, 0) < skip AND coalesce(right, 0) < skip")
            .select(*trace, "seq")
        )
        judged = snapshot(judged)
        if judged.isEmpty():
            return rows
        before = judged.select(*trace, (F.col("seq") + 1).alias("seq"))
        gone = judged.join(before, [*trace, "seq"], "left_anti")
        rows = snapshot(renumber(rows.join(gone, [*trace, "seq"], "left_anti"), trace, "seq"))


def as_arrays(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """One edge array per trip (bounded by the trip): group, trace_id, ids."""
    return edges.groupBy(*group, "trace_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "node"))), lambda s: s["node"]).alias("ids")
    )


def collapse_sequences(seqs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distinct sequences with the number of traces carrying them, named by the least trace."""
    return seqs.groupBy(*group, "ids").agg(F.min("trace_id").alias("trace_id"), F.count(F.lit(1)).alias("copies"))


def _tail_head(left: str, right: str, k: Column) -> Column:
    """Do the last k of left equal the first k of right?"""
    return F.slice(left, F.size(left) - k + 1, k) == F.slice(right, 1, k)


def connected_sequences(seqs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sequences that contain, lie in, or end-to-end overlap another; all when a group has at most two.

    ``seqs``: group, trace_id, ids, copies. Candidates meet on a first or last
    edge, and a semi join stops at the first partner.
    """
    on = list(group)
    pos = snapshot(seqs.select(*on, F.col("trace_id").alias("other"), F.col("ids").alias("oids"), F.posexplode("ids").alias("p", "at")))
    total = seqs.groupBy(*on).agg(F.sum("copies").alias("n"))
    rows = seqs.join(total, on)
    head = rows.withColumn("at", F.element_at("ids", 1))
    tail = rows.withColumn("at", F.element_at("ids", -1))
    meet = lambda side, cond: side.alias("l").join(
        pos.alias("r"), _equal(on, "at") & (F.col("l.trace_id") != F.col("r.other")) & cond, "left_semi"
    ).select(*on, "trace_id")
    size, osize = F.size("l.ids"), F.size("r.oids")
    inside = meet(head, (osize - F.col("r.p") >= size) & (F.slice("r.oids", F.col("r.p") + 1, size) == F.col("l.ids")))
    prefix = meet(head, (osize - F.col("r.p") <= size) & (F.slice("r.oids", F.col("r.p") + 1, osize - F.col("r.p")) == F.slice("l.ids", 1, osize - F.col("r.p"))))
    suffix = meet(tail, (F.col("r.p") + 1 <= size) & (F.slice("r.oids", 1, F.col("r.p") + 1) == F.slice("l.ids", size - F.col("r.p"), F.col("r.p") + 1)))
    # Containing another: the other's whole sequence starts at some edge of ours.
    mine = seqs.select(*on, "trace_id", "ids", F.posexplode("ids").alias("p", "at"))
    others = seqs.select(*on, F.col("trace_id").alias("other"), F.col("ids").alias("oids"), F.element_at("ids", 1).alias("at"))
    holds = mine.alias("l").join(
        others.alias("r"), _equal(on, "at") & (F.col("l.trace_id") != F.col("r.other")) & (F.slice("l.ids", F.col("l.p") + 1, F.size("r.oids")) == F.col("r.oids")), "left_semi"
    ).select(*on, "trace_id")
    few = rows.where("n <= 2 OR copies > 1").select(*on, "trace_id")
    kept = inside.union(prefix).union(suffix).union(holds).union(few).distinct()
    return seqs.join(kept, [*on, "trace_id"], "left_semi")


def _equal(on, *more) -> Column:
    match = F.lit(True)
    for k in [*on, *more]:
        match = match & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return match


def assemble_overlaps(seqs: DataFrame, group: Sequence[str], min_overlap: int = 1) -> DataFrame:
    """Grow fragments by exact suffix–prefix overlaps, all groups in step.

    A fragment starts at the sequence containing most others (then greatest
    coverage, then length). Each round drops what the fragment already contains
    and takes the best merge by overlap, added edges and support; when two
    different best merges tie the fragment is marked ambiguous and closed. With
    no merge left the next fragment starts. Supports are those of the input.
    """
    on = list(group)
    node_w = seqs.select(*on, "copies", F.explode(F.array_distinct("ids")).alias("node")).groupBy(*on, "node").agg(F.sum("copies").alias("w"))
    pairs = lambda c: F.array_distinct(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    many = seqs.where(F.size("ids") > 1)
    pair_w = many.select(*on, "copies", F.explode(pairs("ids")).alias("p")).groupBy(*on, "p").agg(F.sum("copies").alias("pw"))
    node_s = seqs.select(*on, "trace_id", F.explode(F.array_distinct("ids")).alias("node")).join(node_w, [*on, "node"]).groupBy(*on, "trace_id").agg(F.sum("w").alias("s1"))
    pair_s = many.select(*on, "trace_id", F.explode(pairs("ids")).alias("p")).join(pair_w, [*on, "p"]).groupBy(*on, "trace_id").agg(F.sum("pw").alias("s2"))
    # Coverage of others: the share of their edges found here, and how many lie here whole.
    pool = seqs.join(node_s, [*on, "trace_id"]).join(pair_s, [*on, "trace_id"], "left").select(
        *on, "trace_id", "ids", "copies", (F.col("s1") + F.coalesce("s2", F.lit(0))).alias("support")
    )
    pool = snapshot(pool)
    held = lambda big, small: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(big) - F.size(small) + 1)), lambda i: F.slice(big, i, F.size(small)) == F.col(small))
    shared = (
        pool.select(*on, F.col("trace_id").alias("a"), F.explode(F.array_distinct("ids")).alias("node"))
        .join(pool.select(*on, F.col("trace_id").alias("b"), F.explode(F.array_distinct("ids")).alias("node")), [*on, "node"])
        .where("a <> b").groupBy(*on, "a", "b").agg(F.count(F.lit(1)).alias("same"))
    )
    seq_of = lambda name, ids: pool.select(*on, F.col("trace_id").alias(name), F.col("ids").alias(ids), F.col("copies").alias(f"{name}_copies"))
    scored = snapshot(
        shared.join(seq_of("a", "big"), [*on, "a"]).join(seq_of("b", "small"), [*on, "b"])
        .select(*on, "a", "b", "b_copies", (F.col("same") / F.size(F.array_distinct("small"))).alias("cover"), ((F.size("small") <= F.size("big")) & held("big", "small")).alias("whole"))
    )
    done = None
    contig = None
    index = 0
    while True:
        if contig is None:
            if pool.isEmpty():
                return done
            alive = pool.select(*on, F.col("trace_id").alias("b"))
            seeds = scored.join(alive, [*on, "b"], "left_semi").groupBy(*on, F.col("a").alias("trace_id")).agg(
                F.sum(F.when(F.col("whole"), F.col("b_copies")).otherwise(0)).alias("contains"), F.sum(F.col("cover") * F.col("b_copies")).alias("coverage")
            )
            ranked = pool.join(seeds, [*on, "trace_id"], "left").fillna(0, ["contains"]).fillna(0.0, ["coverage"])
            best = ranked.groupBy(*on).agg(F.min_by(F.struct("trace_id", "ids", "copies"), F.struct(-F.col("contains"), -F.col("coverage"), -F.size("ids"), "trace_id")).alias("s"))
            contig = snapshot(best.select(*on, "s.ids", F.col("s.copies").alias("traces"), F.lit(0).alias("merges"), F.lit(False).alias("ambiguous"), F.col("s.trace_id").alias("_took")))
            pool = snapshot(pool.join(contig.select(*on, F.col("_took").alias("trace_id")), [*on, "trace_id"], "left_anti"))
            contig = snapshot(contig.drop("_took"))
        grown = contig.select(*on, F.col("ids").alias("contig"), "ambiguous")
        faced = pool.join(grown, on)
        inside = snapshot(faced.where((F.size("ids") <= F.size("contig")) & held("contig", "ids")).select(*on, "trace_id", "copies"))
        pool = snapshot(pool.join(inside.select(*on, "trace_id"), [*on, "trace_id"], "left_anti"))
        gained = inside.groupBy(*on).agg(F.sum("copies").alias("g"))
        contig = snapshot(contig.join(gained, on, "left").withColumn("traces", F.col("traces") + F.coalesce("g", F.lit(0))).drop("g"))
        faced = pool.join(grown.where("NOT ambiguous"), on)
        room = F.least(F.size("ids"), F.size("contig"))
        longest = lambda left, right: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), room), lambda k: _tail_head(left, right, k))), F.lit(0))
        offers = faced.withColumns({"after": longest("contig", "ids"), "before": longest("ids", "contig")})
        sides = F.explode(F.array(F.struct(F.lit(True).alias("append"), F.col("after").alias("k")), F.struct(F.lit(False).alias("append"), F.col("before").alias("k"))))
        offers = offers.withColumn("o", sides).where(F.col("o.k") >= min_overlap).select(
            *on, "trace_id", "copies", F.col("o.k").alias("k"), (F.size("ids") - F.col("o.k")).alias("added"), "support",
            F.when(F.col("o.append"), F.concat("contig", F.slice("ids", F.col("o.k") + 1, F.size("ids") - F.col("o.k")))).otherwise(
                F.concat(F.slice("ids", 1, F.size("ids") - F.col("o.k")), "contig")
            ).alias("merged"),
        )
        offers = snapshot(offers.withColumn("rank", F.struct("k", "added", "support")))
        top = offers.groupBy(*on).agg(F.max("rank").alias("rank"))
        tied = offers.join(top, [*on, "rank"])
        pick = snapshot(
            tied.groupBy(*on).agg(F.min(F.struct("merged", "trace_id", "copies")).alias("p"), F.count_distinct("merged").alias("ways"))
            .select(*on, "p.*", "ways")
        )
        if pick.isEmpty():
            finished = contig.withColumn("fragment_index", F.lit(index))
            done = finished if done is None else snapshot(done.unionByName(finished))
            contig, index = None, index + 1
            continue
        clear = pick.where("ways = 1")
        pool = snapshot(pool.join(clear.select(*on, "trace_id"), [*on, "trace_id"], "left_anti"))
        contig = snapshot(
            contig.join(pick, on, "left").select(
                *on, F.when(F.col("ways") == 1, F.col("merged")).otherwise(F.col("ids")).alias("ids"),
                (F.col("traces") + F.when(F.col("ways") == 1, F.col("copies")).otherwise(F.lit(0))).alias("traces"),
                (F.col("merges") + F.when(F.col("ways") == 1, 1).otherwise(0)).alias("merges"),
                (F.col("ambiguous") | F.coalesce(F.col("ways") > 1, F.lit(False))).alias("ambiguous"),
            )
        )
    raise RuntimeError("assembly did not end")
