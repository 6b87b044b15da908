"""State changes of lines, sessions, routes, detours and notifications.

Every step is a function from tables to tables and counts. The present moment is
always an argument, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators.frechet import frechet
from ..operators.ordered import islands
from ..operators.quadtree import box_pairs
from ..session import snapshot


# --- lines -----------------------------------------------------------------

def name_keepers(lines: DataFrame) -> DataFrame:
    """Draft lines with the oldest line of the same normalised name as keeper."""
    keyed = lines.where("status = 'draft'").withColumn("key", scalar.line_name_key(F.col("name"))).where("key <> ''")
    oldest = keyed.groupBy("key").agg(F.min_by("line_id", F.struct("created_at", "line_id")).alias("keeper"))
    return keyed.join(oldest, "key").select("line_id", "key", "keeper")


def envelope_overlaps(boxes: DataFrame, min_ratio: float = 0.7) -> DataFrame:
    """Ordered pairs of lines whose envelopes share at most of the smaller one: a, b, ratio.

    ``boxes``: line_id, w, e, s, n. Both directions are returned; the ratio is 0
    when the smaller envelope has no area.
    """
    pairs = box_pairs(boxes, [], "line_id", once=False)
    wide = F.least("e_a", "e_b") - F.greatest("w_a", "w_b")
    high = F.least("n_a", "n_b") - F.greatest("s_a", "s_b")
    area = lambda s: (F.col(f"e_{s}") - F.col(f"w_{s}")) * (F.col(f"n_{s}") - F.col(f"s_{s}"))
    smaller = F.least(area("a"), area("b"))
    ratio = F.when(smaller > 0, wide * high / smaller).otherwise(F.lit(0.0))
    return pairs.select("a", "b", ratio.alias("ratio")).where(F.col("ratio") >= min_ratio)


def line_envelopes(points: DataFrame) -> DataFrame:
    return points.groupBy("line_id").agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    )


def _merge_overlapping(pairs: DataFrame, ages: DataFrame) -> DataFrame:
    """Merge the strongest overlaps first; the older line stays and may take more.

    A pair is settled once no stronger one left could take either of its lines,
    so a line takes all that it wins in one round, as a scan in rank order would.
    """
    side = lambda name: ages.select(F.col("line_id").alias(name), F.struct("created_at", "line_id").alias(f"_age_{name}"))
    met = pairs.where("a < b").join(side("a"), "a").join(side("b"), "b")
    older_a = F.col("_age_a") < F.col("_age_b")
    left = snapshot(met.select(
        F.when(older_a, F.col("b")).otherwise(F.col("a")).alias("line_id"), F.when(older_a, F.col("a")).otherwise(F.col("b")).alias("target"),
        F.struct((-F.col("ratio")).alias("r"), "a", "b").alias("_rank"),
    ))
    merges = None
    while True:
        if left.isEmpty():
            return merges if merges is not None else left.select("line_id", "target")
        # The strongest pair that takes a line is the only one that can.
        taking = left.groupBy("line_id").agg(F.min_by("target", "_rank").alias("target"), F.min("_rank").alias("_rank"))
        risk = taking.select(F.col("line_id").alias("target"), F.col("_rank").alias("_risk"))
        now = snapshot(taking.join(risk, "target", "left").where("_risk IS NULL OR _rank < _risk").select("line_id", "target", "_rank"))
        found = now.select("line_id", "target")
        merges = found if merges is None else snapshot(merges.union(found))
        left = left.join(now.select("line_id"), "line_id", "left_anti")
        # A line that goes later than a pair could still take in that pair.
        ends = now.select(F.col("line_id").alias("target"), F.col("_rank").alias("_end"))
        left = snapshot(left.join(ends, "target", "left").where("_end IS NULL OR _rank < _end").drop("_end"))


def deduplicate_lines(lines: DataFrame, points: DataFrame, min_ratio: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge draft lines by name, into known lines, then by envelope; promote the rest.

    Returns lines, the merge map (line_id, target, why) and counts. When several
    known lines share a name, the oldest takes the draft.
    """
    keepers = snapshot(name_keepers(lines))
    by_name = keepers.where("line_id <> keeper").select("line_id", F.col("keeper").alias("target"), F.lit("name").alias("why"))
    known = (
        lines.where("status IN ('approved', 'pending')").withColumn("key", scalar.line_name_key(F.col("name"))).where("key <> ''")
        .groupBy("key").agg(F.min_by("line_id", F.struct("created_at", "line_id")).alias("target"))
    )
    into_known = keepers.where("line_id = keeper").join(known, "key").select("line_id", "target", F.lit("known").alias("why"))
    drafts = lines.where("status = 'draft'").select("line_id", "created_at")
    open_drafts = snapshot(drafts.join(by_name.union(into_known).select("line_id"), "line_id", "left_anti"))
    boxes = line_envelopes(points.join(open_drafts.select("line_id"), "line_id", "left_semi"))
    by_box = _merge_overlapping(envelope_overlaps(boxes, min_ratio), open_drafts).withColumn("why", F.lit("overlap"))
    merges = snapshot(by_name.union(into_known).union(by_box))
    out = apply_line_status(lines, merges)
    promoted = F.when(F.col("status") == "draft", "pending").otherwise(F.col("status"))
    stats = drafts.agg(F.count(F.lit(1)).alias("draft_lines")).join(
        merges.agg(
            F.count_if(F.col("why") == "name").alias("merged_by_name"), F.count_if(F.col("why") == "known").alias("merged_into_existing"),
            F.count_if(F.col("why") == "overlap").alias("merged_by_overlap"),
        ),
        F.lit(True),
    ).withColumn("promoted_to_pending", F.expr("draft_lines - merged_by_name - merged_into_existing - merged_by_overlap"))
    return out.withColumn("status", promoted), merges, stats


def apply_line_status(lines: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged lines and their targets; lines that were merged before keep theirs."""
    before = F.col("merged_into_id") if "merged_into_id" in lines.columns else F.lit(None)
    return lines.join(merges.select("line_id", F.col("target").alias("_target")), "line_id", "left").withColumns({
        "merged_into_id": F.coalesce("_target", before), "status": F.when(F.col("_target").isNotNull(), "merged").otherwise(F.col("status")),
    }).drop("_target")


def valid_merges(requests: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split merge requests (line_id, target) into valid ones and rejects with a reason."""
    state = lambda name: lines.select(F.col("line_id").alias(name), F.col("status").alias(f"_{name}"))
    judged = requests.join(state("line_id"), "line_id", "left").join(state("target"), "target", "left").withColumn(
        "rejected_because",
        F.when(F.col("line_id") == F.col("target"), "same_line")
        .when(F.col("_line_id").isNull() | F.col("_target").isNull(), "unknown_line")
        .when((F.col("_line_id") == "merged") | (F.col("_target") == "merged"), "already_merged"),
    )
    good = judged.where("rejected_because IS NULL").groupBy("line_id").agg(F.min("target").alias("target"))
    return good, judged.where("rejected_because IS NOT NULL").select("line_id", "target", "rejected_because")


def move_rows(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Re-point the line of sessions or trips by a merge map; adds ``moved``."""
    return rows.join(merges.select("line_id", "target"), "line_id", "left").select(
        *[F.coalesce("target", "line_id").alias(c) if c == "line_id" else F.col(c) for c in rows.columns], F.col("target").isNotNull().alias("moved")
    )


def _in_order(changes: DataFrame, key: str) -> DataFrame:
    """Changes with ``_late``: true for all but the earliest of each id (by time, then change id)."""
    once = changes.dropDuplicates([key, "change_id"])
    first = once.groupBy(key).agg(F.min(F.struct("at", "change_id")).alias("_first"))
    return once.join(first, key).withColumn("_late", F.struct("at", "change_id") > F.col("_first")).drop("_first")


def change_lines(lines: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Create, update, approve and delete lines.

    ``changes``: change_id, action, line_id, name?, line_type?, at. New lines
    are pending; only pending lines can be approved; unknown ids are rejected.
    Of several changes of one line the earliest counts, the others are rejected.
    """
    judged = _in_order(changes, "line_id").join(lines.select("line_id", F.col("status").alias("_status")), "line_id", "left").withColumn(
        "rejected_because",
        F.when(F.col("_late"), "later_in_batch")
        .when((F.col("action") == "create") & F.col("_status").isNotNull(), "exists")
        .when((F.col("action") != "create") & F.col("_status").isNull(), "unknown_line")
        .when((F.col("action") == "approve") & (F.col("_status") != "pending"), "not_pending"),
    )
    good = judged.where("rejected_because IS NULL").select("line_id", "action", F.col("name").alias("_name"), F.col("line_type").alias("_type"), F.col("at").alias("_at"))
    out = lines.join(good, "line_id", "full").where("coalesce(action, '') <> 'delete'")
    fields = {
        "name": F.coalesce("_name", "name"), "line_type": F.coalesce("_type", "line_type"), "created_at": F.coalesce("created_at", "_at"),
        "status": F.when(F.col("action") == "create", "pending").when(F.col("action") == "approve", "approved").otherwise(F.col("status")),
    }
    return out.select(*[fields.get(c, F.col(c)).alias(c) for c in lines.columns]), judged.where("rejected_because IS NOT NULL").select(
        "change_id", "line_id", "action", "rejected_because"
    )


def change_sessions(sessions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start, cancel, resume and assign-device requests on sessions.

    ``changes``: change_id, action, session_id, device_id?, at. Cancel and
    assign need an in-progress session, resume an abandoned one. Of several
    requests on one session the earliest counts, the others are rejected.
    """
    judged = _in_order(changes, "session_id").join(sessions.select("session_id", F.col("status").alias("_status")), "session_id", "left").withColumn(
        "rejected_because",
        F.when(F.col("_late"), "later_in_batch")
        .when((F.col("action") == "start") & F.col("_status").isNotNull(), "exists")
        .when((F.col("action") != "start") & F.col("_status").isNull(), "unknown_session")
        .when(F.col("action").isin("cancel", "assign") & (F.col("_status") != "in_progress"), "not_in_progress")
        .when((F.col("action") == "resume") & (F.col("_status") != "abandoned"), "not_abandoned"),
    )
    good = judged.where("rejected_because IS NULL").select("session_id", "action", F.col("device_id").alias("_device"), F.col("at").alias("_at"))
    out = sessions.join(good, "session_id", "full")
    starts = F.col("action").isin("start", "resume")
    fields = {
        "device_id": F.coalesce("_device", "device_id"),
        "status": F.when(starts, "in_progress").when(F.col("action") == "cancel", "cancelled").otherwise(F.col("status")),
        "ended_at": F.when(F.col("action") == "cancel", F.col("_at")).when(starts, None).otherwise(F.col("ended_at")),
        "started_at": F.coalesce("started_at", "_at"),
        "last_activity_at": F.when(starts, F.col("_at")).otherwise(F.col("last_activity_at")),
        "processing_status": F.coalesce("processing_status", F.lit("raw")),
    }
    return out.select(*[fields.get(c, F.col(c)).alias(c) for c in sessions.columns]), judged.where("rejected_because IS NOT NULL").select(
        "change_id", "session_id", "action", "rejected_because"
    )


def delete_lines(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove lines and everything hanging on them: by line, then by route, edge and session."""
    out = dict(tables)
    drop = lambda df, gone, key: df.join(gone.select(key).distinct(), key, "left_anti")
    held = lambda name, key: tables[name].join(ids.select("line_id"), "line_id", "left_semi").select(key)
    chains = {"route_edges": ("routes", "route_id"), "ramal_descriptors": ("routes", "route_id"), "points": ("sessions", "session_id"), "trip_points": ("trips", "trip_id"), "trip_edges": ("trips", "trip_id")}
    for name, df in tables.items():
        if name in chains and chains[name][0] in tables and "line_id" not in df.columns:
            owner, key = chains[name]
            out[name] = drop(df, held(owner, key), key)
        elif name == "edge_votes" and "route_edges" in tables and "routes" in tables:
            edges = tables["route_edges"].join(held("routes", "route_id"), "route_id", "left_semi").select("route_edge_id")
            out[name] = drop(df, edges, "route_edge_id")
        elif "line_id" in df.columns:
            out[name] = drop(df, ids, "line_id")
    return out


# --- sessions and detours ----------------------------------------------------

def abandon_stale(sessions: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Close in-progress sessions silent for longer than ``minutes``; adds ``abandoned_now``."""
    stale = (F.col("status") == "in_progress") & (F.col("last_activity_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return sessions.withColumns(
        {
            "abandoned_now": stale, "ended_at": F.when(stale, F.col("last_activity_at")).otherwise(F.col("ended_at")),
            "status": F.when(stale, "abandoned").otherwise(F.col("status")),
        }
    )


def expire_detours(detours: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Expire active detours not confirmed for a week; adds ``expired_now``."""
    old = (F.col("status") == "active") & (F.col("last_confirmed_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    return detours.withColumns({"expired_now": old, "status": F.when(old, "expired").otherwise(F.col("status"))})


def confirm_detours(detours: DataFrame, confirms: DataFrame) -> DataFrame:
    """Apply confirmations (detour_id, at) to active detours."""
    sums = confirms.groupBy("detour_id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    hit = (F.col("status") == "active") & F.col("_n").isNotNull()
    return detours.join(sums, "detour_id", "left").withColumns(
        {
            "confirmed_count": F.when(hit, F.col("confirmed_count") + F.col("_n")).otherwise(F.col("confirmed_count")),
            "last_confirmed_at": F.when(hit, F.greatest("last_confirmed_at", "_at")).otherwise(F.col("last_confirmed_at")),
        }
    ).drop("_n", "_at")


def dispatch_decisions(targets: DataFrame, log: DataFrame, now: Column, limit: int = 3) -> DataFrame:
    """What each (device, line) gets now: individual, coalesced or nothing.

    ``targets``: device_id, line_id; ``log``: device_id, line_id, kind, sent_at.
    Only the last 24 hours count.
    """
    recent = log.where((F.col("sent_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("sent_at") <= now)).groupBy("device_id", "line_id").agg(
        F.count_if(F.col("kind") == "individual").alias("n_individual"), F.count_if(F.col("kind") == "coalesced").alias("n_coalesced")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    kind = F.when(n("n_coalesced") >= 1, "skipped").when(n("n_individual") < limit, "individual").otherwise("coalesced")
    return targets.join(recent, ["device_id", "line_id"], "left").select("device_id", "line_id", kind.alias("decision"))


# --- route versions ------------------------------------------------------------

def version_decisions(candidates: DataFrame, active: DataFrame, history: DataFrame, now: Column, threshold_m: float = 50.0) -> DataFrame:
    """Decide per (line, label): create, unchanged or supersede, with the version to write.

    ``candidates``: line_id, ramal_label, path; ``active``: the same plus
    route_id; ``history``: line_id, ramal_label, version. Labels not rebuilt this
    time are not touched.
    """
    on = ["line_id", "ramal_label"]
    top = history.groupBy(*on).agg(F.max("version").alias("_top"))
    out = candidates.join(active.select(*on, F.col("route_id").alias("active_route_id"), F.col("path").alias("active_path")), on, "left").join(top, on, "left")
    out = out.withColumn("metres", F.when(F.col("active_path").isNotNull(), frechet("active_path", "path")))
    decision = (
        F.when(F.size("path") < 2, "rejected").when(F.col("active_path").isNull(), "create").when(F.col("metres") < threshold_m, "unchanged").otherwise("supersede")
    )
    out = out.withColumn("decision", decision)
    writes = F.col("decision").isin("create", "supersede")
    return out.select(
        *on, "path", "decision", "metres", "active_route_id",
        F.when(writes, F.coalesce("_top", F.lit(0)) + 1).alias("version"),
        F.when(F.col("decision") == "unchanged", now).alias("last_compared_at"),
    )


def apply_versions(routes: DataFrame, decisions: DataFrame, strategy: str) -> DataFrame:
    """Routes after the decisions: superseded old versions, new pending ones, touched unchanged ones."""
    old = decisions.where("active_route_id IS NOT NULL").select(
        F.col("active_route_id").alias("route_id"), F.col("decision").alias("_d"), F.col("last_compared_at").alias("_seen")
    )
    seen = F.col("last_compared_at") if "last_compared_at" in routes.columns else F.lit(None).cast("timestamp")
    kept = routes.join(old, "route_id", "left").select(
        *[c for c in routes.columns if c not in ("status", "last_compared_at")],
        F.when(F.col("_d") == "supersede", "superseded").otherwise(F.col("status")).alias("status"),
        F.coalesce("_seen", seen).alias("last_compared_at"),
    )
    new = decisions.where("version IS NOT NULL").select(
        F.concat_ws("/", F.col("line_id").cast("string"), "ramal_label", F.concat(F.lit("v"), F.col("version").cast("string"))).alias("route_id"),
        "line_id", "ramal_label", F.col("version").cast("int").alias("version"), F.lit("pending").alias("status"), F.lit(strategy).alias("strategy_key"),
        F.lit(1).alias("fragment_count"),
    )
    return kept.withColumn("route_id", F.col("route_id").cast("string")).unionByName(new, allowMissingColumns=True)


def edges_of_route(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Cut consensus coordinates into route edges by the road edge each point matched.

    ``points``: route_id, i, lon, lat, edge_index (null when unmatched);
    ``edges``: route_id, edge_index, edge_id, forward. Unmatched points stay
    with the edge before, neighbours share the boundary point, and pieces of
    one point are skipped. Routes without usable matches become one edge.
    A route is bounded, so windows run inside it.
    """
    w = Window.partitionBy("route_id").orderBy("i")
    valid = points.join(edges.select("route_id", "edge_index", F.lit(True).alias("_ok")), ["route_id", "edge_index"], "left").withColumn(
        "edge_index", F.when(F.col("_ok"), F.col("edge_index"))
    )
    carried = valid.withColumn("_e", F.coalesce(F.last("edge_index", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    run = F.sum((F.col("_e") != F.coalesce(F.lag("_e").over(w), F.lit(-1))).cast("int")).over(w)
    runs = carried.withColumn("_run", run).withColumn("_prev", F.lag("_run").over(w))
    spread = runs.withColumn("_home", F.explode(F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("_run")), F.array("_prev", "_run")).otherwise(F.array("_run"))))
    pieces = spread.groupBy("route_id", "_home").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("path"),
        F.min(F.when(F.col("_home") == F.col("_run"), F.col("_e"))).alias("edge_index"),
        F.max(F.col("_ok")).alias("_any"),
    ).where(F.size("path") >= 2)
    seq = F.row_number().over(Window.partitionBy("route_id").orderBy("_home")) - 1
    cut = pieces.withColumn("sequence", seq).join(edges, ["route_id", "edge_index"], "left")
    matched = edges.select("route_id").distinct()
    whole = points.join(matched, "route_id", "left_anti").groupBy("route_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("path")
    )
    return cut.join(matched, "route_id", "left_semi").select("route_id", "sequence", "edge_id", "forward", "path").union(
        whole.select("route_id", F.lit(0).alias("sequence"), F.lit(None).cast("bigint").alias("edge_id"), F.lit(True).alias("forward"), "path")
    )


def street_summary(edges: DataFrame, keys: Sequence[str], seq: str = "seq", min_run_m: float = 200.0) -> DataFrame:
    """Street names along each sequence of matched edges: keys, place, street.

    ``edges``: keys, dense seq, street (null or empty breaks the run), length_km.
    Runs shorter than 200 m are dropped, then immediate repeats.
    """
    named = edges.withColumn("street", F.nullif("street", F.lit("")))
    runs = islands(named, keys, seq, same=["street"], name="run").where("street IS NOT NULL")
    long = runs.groupBy(*keys, "run", "street").agg(F.sum(F.coalesce("length_km", F.lit(0.0)) * 1000).alias("m")).where(F.col("m") >= min_run_m)
    w = Window.partitionBy(*keys).orderBy("run")
    kept = long.withColumn("_p", F.lag("street").over(w)).where("_p IS NULL OR _p <> street")
    return kept.select(*keys, (F.row_number().over(w) - 1).alias("place"), "street")


def supersede_fragmented(routes: DataFrame) -> DataFrame:
    """Retire live routes stored in several fragments; adds ``superseded_now``."""
    hit = (F.col("status") != "superseded") & (F.col("fragment_count") > 1)
    return routes.withColumns({"superseded_now": hit, "status": F.when(hit, "superseded").otherwise(F.col("status"))})


def import_routes(files: DataFrame, lines: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New route versions from route files.

    ``files``: file, line_name, fragment_index, path. Lines are found by name or
    made; all fragments of a file share one new version, and every live route
    of a touched line is superseded. Returns lines, routes and the new routes
    with their paths.
    """
    wanted = files.select(F.col("line_name").alias("name")).distinct()
    known = lines.groupBy("name").agg(F.min_by(F.col("line_id").cast("string"), F.struct("created_at", "line_id")).alias("line_id"))
    found = wanted.join(known, "name", "left").withColumn("is_new", F.col("line_id").isNull()).withColumn(
        "line_id", F.coalesce("line_id", F.concat(F.lit("imported-"), F.col("name")))
    )
    made = found.where("is_new").select("line_id", "name", F.lit("approved").alias("status"))
    top = routes.groupBy(F.col("line_id").cast("string").alias("line_id")).agg(F.max("version").alias("top"))
    order = F.dense_rank().over(Window.partitionBy("line_id").orderBy("file"))
    new = (
        files.join(found.withColumnRenamed("name", "line_name"), "line_name").join(top, "line_id", "left")
        .withColumn("version", (F.coalesce("top", F.lit(0)) + order).cast("int"))
    )
    count = new.groupBy("file").agg(F.count(F.lit(1)).alias("fragment_count"))
    last = new.groupBy("line_id").agg(F.max("version").alias("_last"))
    new = new.join(count, "file").join(last, "line_id").select(
        F.concat_ws("/", "line_id", F.concat(F.lit("v"), F.col("version").cast("string")), F.col("fragment_index").cast("string")).alias("route_id"), "line_id", "version",
        F.when(F.col("version") < F.col("_last"), "superseded").otherwise("confirmed").alias("status"), F.lit("imported").alias("source"),
        F.col("fragment_index").cast("int").alias("fragment_index"), F.col("fragment_count").cast("int").alias("fragment_count"), "path",
    )
    touched = found.select(F.col("line_id").alias("_l"), F.lit(True).alias("_hit"))
    old = routes.join(touched, F.col("line_id").cast("string") == F.col("_l"), "left").withColumn(
        "status", F.when(F.coalesce("_hit", F.lit(False)), "superseded").otherwise(F.col("status"))
    ).drop("_l", "_hit").withColumns({"route_id": F.col("route_id").cast("string"), "line_id": F.col("line_id").cast("string")})
    all_lines = lines.withColumn("line_id", F.col("line_id").cast("string")).unionByName(made, allowMissingColumns=True)
    return all_lines, old.unionByName(new.drop("path"), allowMissingColumns=True), new
