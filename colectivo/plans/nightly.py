"""The nightly run: ten steps over the platform's tables, each on the lines that the steps before it touched.

A run is a graph of steps. Steps that don't wait for each other run side by
side, so that small jobs share the cluster with large ones. A step gets the
tables as its predecessors left them and the lines they touched; it hands back
the tables it replaces, the lines it touched itself and its counts. Work that
depends on a line's recordings is done for touched lines only, so a second run
on what the first one wrote has nothing to do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import datetime, timezone
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Engine
from ..functions import geo
from ..operators import cleaning, fares, schedules, votes
from ..session import snapshot
from . import consensus, lifecycle, routing

Tables = dict[str, DataFrame]
#: Columns that a table without a line of its own reaches its line through.
OWNERS = {"trip_points": ("trips", "trip_id"), "trip_edges": ("trips", "trip_id")}
LOG = "place int, step string, status string, started_at timestamp, ended_at timestamp, counts map<string,bigint>, error string"


@dataclass
class Change:
    """What a step did: tables it replaces, lines it touched (``line_id``), and one row of counts."""

    tables: Tables
    touched: DataFrame | None = None
    counts: DataFrame | None = None


@dataclass(frozen=True)
class Step:
    """One node of the run: its work, the steps it waits for and the tables it may replace."""

    name: str
    work: Callable[..., Change]
    after: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()


@dataclass
class Run:
    """Tables after the run, the lines it touched, its status and its log."""

    tables: Tables
    touched: DataFrame
    status: str
    log: DataFrame
    changed: set[str] = field(default_factory=set)


def _before(steps: Sequence[Step]) -> dict[str, set[str]]:
    """All steps that must end before each step; two that write one table must be in order."""
    direct = {s.name: set(s.after) for s in steps}
    closed: dict[str, set[str]] = {}
    for name in TopologicalSorter(direct).static_order():
        closed[name] = direct.get(name, set()) | {far for near in direct.get(name, set()) for far in closed[near]}
    for s in steps:
        for o in steps:
            if s.name < o.name and set(s.writes) & set(o.writes) and s.name not in closed[o.name] and o.name not in closed[s.name]:
                raise ValueError(f"{s.name} and {o.name} write one table in no order")
    return closed


def run(
    tables: Tables, now: Column, steps: Sequence[Step] | None = None, only: Iterable[str] | None = None, params: dict[str, dict] | None = None,
    stop_on_error: bool = False, side_by_side: int = 3,
) -> Run:
    """Run the steps, all or those named in ``only`` (unknown names are ignored).

    ``params`` holds further arguments of a step under its name. A step that
    fails leaves all tables as they were and its message in the log; the run
    has then failed, and the other steps go on, or with ``stop_on_error`` none
    is begun any more. Steps that were not begun have no row in the log.
    """
    steps = STEPS if steps is None else steps
    before = _before(steps)
    wanted = {s.name: s for s in steps if only is None or s.name in set(only)}
    graph = TopologicalSorter({name: before[name] & set(wanted) for name in wanted})
    places = {name: i for i, name in enumerate(n for n in TopologicalSorter(before).static_order() if n in wanted)}
    spark = next(iter(tables.values())).sparkSession
    nothing = spark.createDataFrame([], "line_id long")
    state, touched, rows, changed = dict(tables), {}, [], set()
    clock = lambda: datetime.now(timezone.utc).replace(tzinfo=None)

    def attempt(name: str) -> tuple[Change | None, tuple]:
        begun, step = clock(), wanted[name]
        try:
            lines = nothing
            for earlier in sorted(before[name] & set(touched)):
                lines = lines.union(touched[earlier].select("line_id"))
            made = step.work(dict(state), lines.distinct(), now, **(params or {}).get(name, {}))
            if not set(made.tables) <= set(step.writes):
                raise ValueError(f"wrote {sorted(set(made.tables) - set(step.writes))}, which it doesn't own")
            kept = Change({k: snapshot(v) for k, v in made.tables.items()}, snapshot((nothing if made.touched is None else made.touched.select("line_id")).distinct()))
            counts = {} if made.counts is None else {k: int(v or 0) for k, v in made.counts.first().asDict().items()}
            return kept, (places[name], name, "completed", begun, clock(), counts, None)
        except Exception as error:  # noqa: BLE001 - goes into the log; no table has changed
            return None, (places[name], name, "failed", begun, clock(), {}, f"{type(error).__name__}: {error}")

    graph.prepare()
    with ThreadPoolExecutor(side_by_side) as pool:
        open_, stopped = {}, False
        while graph.is_active() and (open_ or not stopped):
            if not stopped:
                open_ |= {pool.submit(attempt, name): name for name in graph.get_ready()}
            for future in wait(open_, return_when=FIRST_COMPLETED).done:
                name, (made, row) = open_.pop(future), future.result()
                rows.append(row)
                if made is None:
                    stopped = stopped or stop_on_error
                else:
                    state.update(made.tables)
                    changed |= set(made.tables)
                    touched[name] = made.touched
                graph.done(name)
    lines = nothing
    for part in touched.values():
        lines = lines.union(part)
    status = "failed" if any(r[2] == "failed" for r in rows) else "completed"
    return Run(state, snapshot(lines.distinct()), status, spark.createDataFrame(sorted(rows), LOG), changed)


# --- the ten steps ---------------------------------------------------------------------------------


def cleanup(t: Tables, touched: DataFrame, now: Column) -> Change:
    """Close silent sessions and expire detours that nobody confirmed."""
    sessions = lifecycle.abandon_stale(t["sessions"], now)
    detours = lifecycle.expire_detours(t["detours"], now)
    ended = snapshot(sessions.where("abandoned_now").select("line_id").union(detours.where("expired_now").select("line_id")))
    counts = sessions.agg(F.count_if("abandoned_now").alias("abandoned")).join(detours.agg(F.count_if("expired_now").alias("expired")), F.lit(True))
    return Change({"sessions": sessions.drop("abandoned_now"), "detours": detours.drop("expired_now")}, ended, counts)


def final_targets(merges: DataFrame) -> DataFrame:
    """Merge map whose targets are never merged themselves; chains are halved each round."""
    ends = snapshot(merges.select("line_id", "target"))
    while True:
        on = ends.select(F.col("line_id").alias("target"), F.col("target").alias("further"))
        step = snapshot(ends.join(on, "target", "left").select("line_id", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        ends = step.select("line_id", "target")
        if step.where("moved").isEmpty():
            return ends


def deduplicate(t: Tables, touched: DataFrame, now: Column, min_ratio: float = 0.7) -> Change:
    """Merge draft lines and hand what hangs on them to the lines they became."""
    points = t["matched"].join(t["sessions"].select("session_id", "line_id"), "session_id").select("line_id", "lon", "lat")
    lines, merges, counts = lifecycle.deduplicate_lines(t["lines"], points, min_ratio)
    ends = final_targets(merges)
    on = ends.select(F.col("line_id").alias("merged_into_id"), F.col("target").alias("further"))
    lines = lines.join(on, "merged_into_id", "left").withColumn("merged_into_id", F.coalesce("further", "merged_into_id"))
    out = {"lines": lines.select(*t["lines"].columns)}
    moved = None
    for name in ("sessions", "trips", "detours", "fare_reports"):
        rows = lifecycle.move_rows(t[name], ends)
        out[name] = rows.drop("moved")
        mine = rows.where("moved").select("line_id")
        moved = mine if moved is None else moved.union(mine)
    return Change(out, moved.distinct(), counts)


def clean_traces(t: Tables, touched: DataFrame, now: Column, min_edges: int = 2) -> Change:
    """Trips from raw completed sessions; a trip that the quality gate refuses is kept as discarded."""
    made = cleaning.build_trips(t["sessions"], t["matched"], t["trace_edges"])
    new, key = snapshot(made["trips"]), ["trip_id"]
    n_points = made["points"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"))
    n_edges = made["edges"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_edges"))
    gate = cleaning.quality_gate(new, n_points, new.select("trip_id", F.lit(1.0).alias("quality")), n_edges, key)
    new = snapshot(new.join(gate, key).withColumn("status", F.when(F.col("dropped_because").isNull(), "clean").otherwise("discarded")).select(*t["trips"].columns))
    raw = t["sessions"].where("status = 'completed' AND processing_status = 'raw'")
    counts = raw.agg(F.count(F.lit(1)).alias("sessions")).join(new.agg(F.count_if(F.col("status") == "clean").alias("clean"), F.count_if(F.col("status") == "discarded").alias("discarded")), F.lit(True))
    tables = {
        "sessions": made["sessions"].select(*t["sessions"].columns), "trips": t["trips"].unionByName(new),
        "trip_points": t["trip_points"].unionByName(made["points"].select(*t["trip_points"].columns)),
        "trip_edges": t["trip_edges"].unionByName(made["edges"].select(*t["trip_edges"].columns)),
    }
    return Change(tables, new.select("line_id"), counts)


def consensus_routes(points: DataFrame, edges: DataFrame, shapes: DataFrame, existing: DataFrame) -> DataFrame:
    """The default strategy: consensus of all traces, its variants named after the live routes they resemble.

    A line's directions are told apart, so a label may come once for each; all
    that resemble no live route get the next free names of their line.
    """
    known = "="  # marks labels that were matched to a live route
    out = consensus.reconstruct(points, edges, shapes, Engine(), existing=existing.withColumn("ramal_label", F.concat(F.lit(known), "ramal_label")))
    found = out.routes.withColumn("old", F.when(F.col("ramal_label").startswith(known), F.substring("ramal_label", 2, 1000)))
    best = Window.partitionBy("line_id", "old").orderBy(F.desc("trace_count"), "direction_group", "route_key")
    found = snapshot(found.withColumn("old", F.when(F.row_number().over(best) == 1, F.col("old"))))
    used = existing.groupBy("line_id").agg(F.collect_set("ramal_label").alias("used"))  # a line has few variants
    fresh = found.where("old IS NULL").withColumn("k", F.row_number().over(Window.partitionBy("line_id").orderBy("direction_group", "ramal_label", "route_key")))
    fresh = fresh.join(used, "line_id", "left").withColumn("used", F.coalesce("used", F.expr("cast(array() AS array<string>)")))
    names = F.transform(F.sequence(F.lit(1), F.col("k") + F.size("used")), lambda i: F.when(i == 1, "main").otherwise(F.concat(F.lit("r"), i.cast("string"))))
    named = fresh.select("line_id", F.element_at(F.array_except(names, F.col("used")), F.col("k")).alias("ramal_label"), "path", "trace_count")
    return named.unionByName(found.where("old IS NOT NULL").select("line_id", F.col("old").alias("ramal_label"), "path", "trace_count"))


def stored_routes(decided: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """What is written of each new version: its edges, its streets in order and the zones of its two ends.

    ``decided``: route_id, line_id, ramal_label, path. The path's points take
    the nearest road edge; a path without any becomes one edge.
    """
    at = decided.select("route_id", F.posexplode("path").alias("point_index", "p")).select("route_id", "point_index", "p.lon", "p.lat")
    ends = lambda i, name: F.element_at("path", i)[name]
    roads = t["roads"].select("edge_id", *(ends(i, c).alias(f"{c}{n}") for i, n in ((1, 1), (-1, 2)) for c in ("lon", "lat")))
    met = snapshot(cleaning.nearest_road_edges(at, roads, ["route_id"]))
    seen = snapshot(cleaning.trace_edges_of(met, ["route_id"]))
    place = Window.partitionBy("route_id").orderBy("point_index")
    change = F.coalesce(F.lag("edge_id").over(place) != F.col("edge_id"), F.lit(True)).cast("int")  # a route is bounded
    numbered = met.where("edge_id IS NOT NULL").withColumn("new", change).withColumn("edge_index", (F.sum("new").over(place) - 1).cast("int"))
    points = at.join(numbered.select("route_id", "point_index", "edge_index"), ["route_id", "point_index"], "left").withColumnRenamed("point_index", "i")
    index = numbered.groupBy("route_id", "edge_index").agg(F.min("edge_id").alias("edge_id"), F.min("forward").alias("forward"))
    cut = lifecycle.edges_of_route(points, index)
    roads_of = t["roads"].select("edge_id", "street", "length_km")
    streets = lifecycle.street_summary(seen.join(roads_of, "edge_id", "left").select("route_id", "seq", "street", "length_km"), ["route_id"])
    named = streets.groupBy("route_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "street"))), lambda s: s["street"]), " - ").alias("street_summary"))
    tips = decided.select("route_id", *(ends(i, c).alias(f"{n}_{c}") for i, n in ((1, "first"), (-1, "last")) for c in ("lon", "lat")))
    for end in ("first", "last"):
        tips = fares.resolve_zone(tips, t["zones"], f"{end}_lon", f"{end}_lat", f"{end}_zone_id")
    stored = decided.select("route_id", F.size("path").alias("vertices")).join(named, "route_id", "left").join(tips.select("route_id", "first_zone_id", "last_zone_id"), "route_id")
    return cut, stored.select("route_id", F.coalesce("street_summary", F.lit("")).alias("street_summary"), "first_zone_id", "last_zone_id")


def reconstruct_routes(t: Tables, touched: DataFrame, now: Column, strategy=consensus_routes, strategy_key: str = "consensus", min_trips: int = 2, threshold_m: float = 50.0) -> Change:
    """New route versions of touched approved lines with enough clean trips.

    A label within 50 m of its live route keeps it, one beyond is superseded by
    the next version, an unknown one begins at version 1; labels that this
    run doesn't rebuild stay. Votes move to the edges that take their place.
    """
    clean = t["trips"].where("status = 'clean'")
    approved = t["lines"].where("status = 'approved'").select("line_id")
    lines = clean.join(touched, "line_id", "left_semi").join(approved, "line_id", "left_semi").groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    lines = snapshot(lines.where(F.col("n") >= min_trips).select("line_id"))
    names = ("create", "unchanged", "supersede", "rejected")
    if lines.isEmpty():
        none = t["routes"].limit(0).agg(*(F.count(F.lit(1)).alias(n) for n in (*names, "lines")))
        return Change({}, None, none)
    trips = snapshot(clean.join(lines, "line_id", "left_semi").select("trip_id", "line_id"))
    own = lambda name: t[name].join(trips, "trip_id").withColumnRenamed("trip_id", "trace_id")
    edges = snapshot(own("trip_edges").select("line_id", "trace_id", "seq", "edge_id", "forward"))
    shapes = edges.select("line_id", "trace_id", "edge_id", "forward").distinct().join(t["roads"].select("edge_id", "path"), "edge_id")
    live = t["routes"].where("status <> 'superseded'").join(lines, "line_id", "left_semi")
    order = F.row_number().over(Window.partitionBy("line_id").orderBy("ramal_label")).cast("int")
    existing = live.where(F.size("path") >= 2).select("line_id", "ramal_label", "path", order.alias("place"))
    found = snapshot(strategy(own("trip_points").select("line_id", "trace_id", "point_index", "lon", "lat"), edges, shapes, existing))
    best = found.groupBy("line_id", "ramal_label").agg(F.max_by(F.struct("path", "trace_count"), F.struct("trace_count", F.size("path"))).alias("b"))
    decisions = snapshot(lifecycle.version_decisions(best.select("line_id", "ramal_label", "b.path"), live.select("line_id", "ramal_label", "route_id", "path"), t["routes"], now, threshold_m))
    routes = snapshot(lifecycle.apply_versions(t["routes"], decisions, strategy_key))
    written = decisions.where("version IS NOT NULL").select("line_id", "ramal_label", "version", F.col("path").alias("_path"))
    fresh = snapshot(routes.where("status = 'pending'").join(written, ["line_id", "ramal_label", "version"]).select("route_id", "line_id", "ramal_label", F.col("_path").alias("path")))
    cut, stored = stored_routes(fresh, t)
    more = stored.join(fresh.select("route_id", "path"), "route_id").join(
        best.select("line_id", "ramal_label", F.col("b.trace_count").alias("trip_count")).join(fresh.select("route_id", "line_id", "ramal_label"), ["line_id", "ramal_label"]).select("route_id", "trip_count"), "route_id"
    )
    added = {c: F.coalesce(F.col(f"_n.{c}"), F.col(f"r.{c}")) for c in more.columns if c != "route_id"}
    routes = routes.alias("r").join(more.alias("_n"), "route_id", "left").select(*[added.get(c, F.col(f"r.{c}" if c != "route_id" else c)).alias(c) for c in t["routes"].columns])
    lineage = fresh.select("route_id", "line_id", "ramal_label")
    new = cut.join(lineage, "route_id").select(
        F.concat_ws("#", "route_id", F.col("sequence").cast("string")).alias("route_edge_id"), "route_id", "line_id", "ramal_label", F.col("sequence").cast("long").alias("sequence"),
        "edge_id", "forward", "path", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("confirmed_at"),
    )
    old = t["route_edges"].join(decisions.where("decision = 'supersede'").select(F.col("active_route_id").alias("route_id")), "route_id", "left_semi")
    carried, moved = votes.carry_votes(old, snapshot(new), t["route_votes"])
    counts = decisions.agg(*(F.count_if(F.col("decision") == n).alias(n) for n in names), F.count_distinct("line_id").alias("lines"))
    changed = decisions.where("version IS NOT NULL").select("line_id")
    return Change({"routes": routes, "route_edges": t["route_edges"].unionByName(carried.select(*t["route_edges"].columns)), "route_votes": moved.drop("moved")}, changed, counts)


def resolve_edge_votes(t: Tables, touched: DataFrame, now: Column) -> Change:
    """Confirm edges of live routes that enough riders approve."""
    tallied = t["route_edges"].join(votes.tallies(t["route_votes"], "route_edge_id"), "route_edge_id", "left").fillna(0, ["votes_for", "votes_against"])
    out = snapshot(votes.resolve_edges(tallied, t["routes"], now))
    return Change({"route_edges": out.select(*t["route_edges"].columns)}, out.where("confirmed_now").select("line_id"), votes.edge_stats(out))


def resolve_routes(t: Tables, touched: DataFrame, now: Column) -> Change:
    """Confirm pending routes whose edges are confirmed."""
    out = snapshot(votes.resolve_routes(t["routes"], t["route_edges"], now))
    counts = out.agg(*(F.count_if(F.col("outcome") == n).alias(n) for n in ("promoted", "insufficient", "no_edges")))
    return Change({"routes": out.select(*t["routes"].columns)}, out.where("outcome = 'promoted'").select("line_id"), counts)


def resolve_line_votes(t: Tables, touched: DataFrame, now: Column) -> Change:
    """Approve pending lines that enough riders know."""
    out = snapshot(votes.resolve_lines(t["lines"], t["line_votes"]))
    counts = t["lines"].agg(F.count_if(F.col("status") == "pending").alias("checked")).join(out.agg(F.count_if("approved_now").alias("approved")), F.lit(True))
    return Change({"lines": out.select(*t["lines"].columns)}, out.where("approved_now").select("line_id"), counts)


def resolve_fares(t: Tables, touched: DataFrame, now: Column) -> Change:
    """Zones of fare reports that have none yet."""
    out = snapshot(fares.resolve_report_zones(t["fare_reports"], t["zones"]))
    was = t["fare_reports"].select("report_id", F.col("boarding_zone_id").isNull().alias("b"), F.col("alighting_zone_id").isNull().alias("a"))
    filled = out.join(was, "report_id").where("(b AND boarding_zone_id IS NOT NULL) OR (a AND alighting_zone_id IS NOT NULL)")
    return Change({"fare_reports": out.select(*t["fare_reports"].columns)}, filled.select("line_id"), fares.resolution_stats(t["fare_reports"], out))


def rebuild_graph(t: Tables, touched: DataFrame, now: Column) -> Change:
    """Nodes, timed edges and transfers of the directions graph, if a route or a line's approval has changed."""
    if touched.isEmpty():
        return Change({}, None, t["routes"].limit(0).agg(*(F.count(F.lit(1)).alias(n) for n in ("nodes", "bus_edges", "transfer_edges", "lines"))))
    spots = t["route_edges"].where(F.size("path") >= 2)
    point = lambda i, c: F.element_at("path", i)[c]
    edges = snapshot(spots.select("line_id", "route_id", "sequence", *(point(i, c).alias(f"{c}{n}") for i, n in ((1, 1), (-1, 2)) for c in ("lon", "lat")), geo.path_length("path").alias("length_m")))
    timed = snapshot(routing.bus_edges(t["lines"], t["routes"], edges))
    nodes, at = routing.merge_nodes(timed)
    nodes, at = snapshot(nodes), snapshot(at)
    gaps, transfers = routing.gap_edges(timed, at), snapshot(routing.transfer_edges(nodes))
    return Change({"graph_nodes": nodes, "graph_edges": timed, "graph_transfers": transfers}, None, routing.graph_stats(nodes, timed, gaps, transfers))


def infer_schedules(t: Tables, touched: DataFrame, now: Column) -> Change:
    """Service hours and headways of touched approved lines."""
    mine = t["sessions"].join(touched, "line_id", "left_semi")
    rows = snapshot(schedules.infer_schedules(t["lines"], mine).select(*t["schedules"].columns))
    counts = rows.agg(F.count_distinct("line_id").alias("lines"), F.count(F.lit(1)).alias("rows"))
    return Change({"schedules": schedules.upsert_schedules(t["schedules"], rows)}, rows.select("line_id"), counts)


STEPS = (
    Step("cleanup", cleanup, (), ("sessions", "detours")),
    Step("deduplicate_lines", deduplicate, ("cleanup",), ("lines", "sessions", "trips", "detours", "fare_reports")),
    Step("clean_traces", clean_traces, ("deduplicate_lines",), ("sessions", "trips", "trip_points", "trip_edges")),
    Step("reconstruct_routes", reconstruct_routes, ("clean_traces",), ("routes", "route_edges", "route_votes")),
    Step("resolve_edge_votes", resolve_edge_votes, ("reconstruct_routes",), ("route_edges",)),
    Step("resolve_routes", resolve_routes, ("resolve_edge_votes",), ("routes",)),
    Step("resolve_line_votes", resolve_line_votes, ("deduplicate_lines",), ("lines",)),
    Step("resolve_fares", resolve_fares, ("deduplicate_lines",), ("fare_reports",)),
    Step("rebuild_graph", rebuild_graph, ("resolve_routes", "resolve_line_votes"), ("graph_nodes", "graph_edges", "graph_transfers")),
    Step("infer_schedules", infer_schedules, ("clean_traces", "resolve_line_votes"), ("schedules",)),
)


# --- tables by line ----------------------------------------------------------------------------------


def publish(done: Run, folder: str, parts: int = 16) -> DataFrame:
    """Write the run's tables below ``folder`` and return how many line parts of each were written.

    Tables with a line lie in parts by a hash of the line. Where a table is
    there already, only the parts of touched lines are replaced, so a run that
    touched nothing writes nothing. Tables without a line are replaced whole
    if a step changed them.
    """
    spark = done.touched.sparkSession
    part = F.pmod(F.xxhash64("line_id"), F.lit(parts)).cast("int")
    hit = snapshot(done.touched.select(part.alias("part")).distinct())
    written = []
    for name, df in done.tables.items():
        there = _exists(spark, f"{folder}/{name}")
        if name in OWNERS:
            owner, key = OWNERS[name]
            df = df.join(done.tables[owner].select(key, "line_id"), key)
        if "line_id" not in df.columns:
            n = int(not there or name in done.changed)
            if n:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
        else:
            rows = df.withColumn("part", part)
            rows = snapshot(rows.join(hit, "part", "left_semi")) if there else rows
            n = rows.select("part").distinct().count()
            if n:
                rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{name}")
        written.append((name, n))
    return spark.createDataFrame(written, "name string, parts int")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception:  # noqa: BLE001 - Spark names a missing path by an analysis error
        return False


def published(spark: SparkSession, folder: str, names: Iterable[str]) -> Tables:
    """The tables that ``publish`` wrote, as they were handed to it."""
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    return {name: df.drop("part", *(["line_id"] if name in OWNERS else [])) for name, df in out.items()}
