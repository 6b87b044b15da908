"""Transit graph and batch origin–destination times.

A ride along one route is one step, however many stops it passes: within a
route the earliest arrival at a stop is its running time plus the least of
(arrival − running time) over the stops before it, a running minimum. A search
round is one ride plus one walk for all origins together, so rounds count
vehicles, not stops.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Routing
from ..functions import geo
from ..operators.quadtree import near_pairs
from ..session import snapshot


def _near(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs within ground metres. ``left``: lon, lat, …; ``right``: rlon, rlat, …."""
    reach = F.lit(metres * 1.02) / F.cos(F.radians(F.least(F.abs("rlat") + metres / 100_000, F.lit(85.0))))
    out = near_pairs(left, right, geo.mercator("lon", "lat"), geo.mercator("rlon", "rlat"), reach)
    return out.withColumn("metres", geo.haversine("lon", "lat", "rlon", "rlat")).where(F.col("metres") <= metres)


def merge_nodes(edges: DataFrame, cfg: Routing = Routing()) -> tuple[DataFrame, DataFrame]:
    """Graph nodes from edge ends, ends within 20 m of an earlier node joining it.

    ``edges``: line_id, route_id, sequence, lon1, lat1, lon2, lat2 with length_m.
    An end is a node when no earlier node lies near; it is settled once all
    earlier ends near it are. Returns nodes (node_id, lon, lat, lines) and the
    map from coordinates to nodes.
    """
    ends = edges.select("line_id", F.explode(F.array(
        F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat"), F.struct("line_id", "route_id", "sequence", F.lit(0).alias("side")).alias("o")),
        F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat"), F.struct("line_id", "route_id", "sequence", F.lit(1).alias("side")).alias("o")),
    )).alias("e"))
    spots = snapshot(ends.groupBy("e.lon", "e.lat").agg(F.min("e.o").alias("o")))
    pairs = _near(spots, spots.select(F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.col("o").alias("ro")), cfg.node_merge_m)
    earlier = snapshot(pairs.where("ro < o").select("lon", "lat", "rlon", "rlat", "ro"))
    undecided = earlier.select("lon", "lat").distinct()
    leaders = snapshot(spots.join(undecided, ["lon", "lat"], "left_anti").select("lon", "lat"))
    open_spots = snapshot(undecided)
    while True:
        if open_spots.isEmpty():
            break
        lead = leaders.select(F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.lit(True).alias("led"))
        wait = open_spots.select(F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.lit(True).alias("waits"))
        state = (
            earlier.join(open_spots, ["lon", "lat"], "left_semi").join(lead, ["rlon", "rlat"], "left").join(wait, ["rlon", "rlat"], "left")
            .groupBy("lon", "lat").agg(F.count("led").alias("led"), F.count("waits").alias("waits"))
        )
        state = snapshot(state)
        leaders = snapshot(leaders.union(state.where("led = 0 AND waits = 0").select("lon", "lat")))
        open_spots = snapshot(state.where("led = 0 AND waits > 0").select("lon", "lat"))
    else:
        raise RuntimeError("node merging did not settle")
    led = leaders.select(F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    joined = earlier.join(led, ["rlon", "rlat"]).groupBy("lon", "lat").agg(F.min_by(F.struct("rlon", "rlat"), "ro").alias("n"))
    own = spots.join(joined, ["lon", "lat"], "left").select(
        "lon", "lat", F.coalesce("n.rlon", "lon").alias("nlon"), F.coalesce("n.rlat", "lat").alias("nlat")
    )
    at = snapshot(own.withColumn("node_id", F.concat_ws(",", F.col("nlon").cast("string"), F.col("nlat").cast("string"))))
    by_line = ends.select(F.col("e.lon").alias("lon"), F.col("e.lat").alias("lat"), "line_id").distinct().join(at, ["lon", "lat"])
    nodes = by_line.groupBy("node_id", F.col("nlon").alias("lon"), F.col("nlat").alias("lat")).agg(F.sort_array(F.collect_set("line_id")).alias("lines"))
    return nodes, at.select("lon", "lat", "node_id", "nlon", "nlat")


def bus_edges(lines: DataFrame, routes: DataFrame, edges: DataFrame, strategy: str | None = None, cfg: Routing = Routing()) -> DataFrame:
    """Timed edges of live routes of approved and pending lines, with both approval flags.

    ``edges``: route_id, sequence, lon1, lat1, lon2, lat2 and length_m (haversine
    of the shape).
    """
    live = routes.where("status <> 'superseded'")
    if strategy:
        live = live.where(F.col("strategy_key") == strategy)
    known = lines.where("status IN ('approved', 'pending')").select("line_id", (F.col("status") == "approved").alias("line_approved"))
    owner = live.join(known, "line_id").select("route_id", "line_id", "line_approved", (F.col("status") == "confirmed").alias("route_confirmed"))
    return edges.drop("line_id").join(owner, "route_id").withColumn("seconds", F.col("length_m") / cfg.bus_m_s)


def route_stops(timed: DataFrame, at: DataFrame, cfg: Routing = Routing()) -> DataFrame:
    """Nodes of each route in riding order with the running time.

    Where merged nodes pull consecutive edges apart, the ride pays the gap. A
    route is bounded by its edges, so its window is too.
    """
    start = at.select(F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("node_id").alias("from_node"), F.col("nlon").alias("flon"), F.col("nlat").alias("flat"))
    end = at.select(F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("node_id").alias("to_node"), F.col("nlon").alias("tlon"), F.col("nlat").alias("tlat"))
    rows = timed.join(start, ["lon1", "lat1"]).join(end, ["lon2", "lat2"])
    w = Window.partitionBy("route_id").orderBy("sequence")
    prev = F.lag(F.struct("to_node", "tlon", "tlat")).over(w)
    rows = rows.withColumn("_p", prev).withColumn(
        "gap_m", F.when(F.col("_p").isNotNull() & (F.col("_p.to_node") != F.col("from_node")), geo.haversine(F.col("_p.tlon"), F.col("_p.tlat"), F.col("flon"), F.col("flat"))).otherwise(F.lit(0.0))
    )
    rows = rows.withColumn("_after", F.sum(F.col("seconds") + F.col("gap_m") / cfg.bus_m_s).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    far = F.sum(F.col("length_m") + F.col("gap_m")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_m", far)
    stop = F.explode(F.array(
        F.struct((F.col("sequence") * 2).alias("pos"), F.col("from_node").alias("node_id"), (F.col("_after") - F.col("seconds")).alias("t"), (F.col("_m") - F.col("length_m")).alias("m")),
        F.struct((F.col("sequence") * 2 + 1).alias("pos"), F.col("to_node").alias("node_id"), F.col("_after").alias("t"), F.col("_m").alias("m")),
    ))
    return rows.select("route_id", "line_id", "line_approved", "route_confirmed", stop.alias("s")).select("route_id", "line_id", "line_approved", "route_confirmed", "s.*")


def gap_edges(timed: DataFrame, at: DataFrame, cfg: Routing = Routing()) -> DataFrame:
    """Edges closing consecutive route edges whose nodes differ."""
    w = Window.partitionBy("route_id").orderBy("sequence")
    end = at.select(F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.struct("node_id", "nlon", "nlat").alias("to"))
    start = at.select(F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.struct("node_id", "nlon", "nlat").alias("from"))
    rows = timed.join(start, ["lon1", "lat1"]).join(end, ["lon2", "lat2"]).withColumn("_p", F.lag("to").over(w))
    rows = rows.where(F.col("_p.node_id") != F.col("from.node_id"))
    m = geo.haversine(F.col("_p.nlon"), F.col("_p.nlat"), F.col("from.nlon"), F.col("from.nlat"))
    return rows.select("route_id", "sequence", F.col("_p.node_id").alias("from_node"), F.col("from.node_id").alias("to_node"), m.alias("metres"), (m / cfg.bus_m_s).alias("seconds"))


def transfer_edges(nodes: DataFrame, cfg: Routing = Routing()) -> DataFrame:
    """Walks of at most 400 m between nodes without a common line, both ways."""
    served = nodes.where(F.size("lines") > 0)
    other = served.select(F.col("node_id").alias("to_node"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.col("lines").alias("rlines"))
    near = _near(served, other, cfg.transfer_m)
    return near.where((F.col("node_id") != F.col("to_node")) & ~F.arrays_overlap("lines", "rlines")).select(
        F.col("node_id").alias("from_node"), "to_node", "metres", (F.col("metres") / cfg.walk_m_s).alias("seconds")
    )


def access_edges(points: DataFrame, nodes: DataFrame, cfg: Routing = Routing()) -> DataFrame:
    """Walks of at most 800 m between places (place_id, lon, lat) and nodes."""
    other = nodes.select("node_id", F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    return _near(points.select("place_id", "lon", "lat"), other, cfg.access_m).select("place_id", "node_id", "metres", (F.col("metres") / cfg.walk_m_s).alias("seconds"))


def graph_stats(nodes: DataFrame, timed: DataFrame, gaps: DataFrame, transfers: DataFrame) -> DataFrame:
    """Counts of nodes, bus edges (gaps included), transfer edges and lines."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    always = F.lit(True)
    bus = n(timed.select("route_id").union(gaps.select("route_id")), "bus_edges")
    lines = nodes.select(F.explode("lines").alias("l")).distinct().agg(F.count(F.lit(1)).alias("lines"))
    return n(nodes, "nodes").join(bus, always).join(n(transfers, "transfer_edges"), always).join(lines, always)


def travel_times(
    pairs: DataFrame, nodes: DataFrame, stops: DataFrame, transfers: DataFrame, pending_lines: bool = False, pending_routes: bool = False,
    cfg: Routing = Routing(),
) -> tuple[DataFrame, DataFrame]:
    """Least time per pair (od_id, olon, olat, dlon, dlat) and its legs.

    Pairs with the same origin share one search, and it is bounded by its goals:
    once all goals of an origin that have a node near them are reached, a node
    farther than the worst of these arrivals can't better any of them and is
    dropped before it spreads. Unreachable pairs give no row.
    Returns totals (od_id, seconds, metres, legs) and legs (od_id, leg, mode,
    line_id, from_node, to_node, metres, seconds).
    """
    usable = stops
    if not pending_lines:
        usable = usable.where("line_approved")
    if not pending_routes:
        usable = usable.where("route_confirmed")
    usable = snapshot(usable.select("route_id", "line_id", "pos", "node_id", "t", "m"))
    walks = snapshot(transfers)
    place = lambda lon, lat: F.concat_ws(",", F.col(lon).cast("string"), F.col(lat).cast("string"))
    asked = snapshot(pairs.withColumns({"origin": place("olon", "olat"), "goal": place("dlon", "dlat")}))
    starts = asked.select(F.col("origin").alias("place_id"), F.col("olon").alias("lon"), F.col("olat").alias("lat")).distinct()
    goals = asked.select(F.col("goal").alias("place_id"), F.col("dlon").alias("lon"), F.col("dlat").alias("lat")).distinct()
    # How a node was reached: previous node (null from the origin), mode, line, metres, seconds.
    none = F.lit(None)
    label = lambda prev, mode, line, metres, seconds: [prev.cast("string").alias("prev"), F.lit(mode).alias("mode"), line.alias("line_id"), metres.alias("metres"), seconds.alias("step_s")]
    line_type = dict(stops.dtypes)["line_id"]
    state = access_edges(starts, nodes, cfg).select(
        F.col("place_id").alias("origin"), "node_id", F.col("seconds").alias("time"), *label(none, "walk", none.cast(line_type), F.col("metres"), F.col("seconds"))
    )
    cols = ["time", "prev", "mode", "line_id", "metres", "step_s"]
    state = snapshot(state)
    out = snapshot(access_edges(goals, nodes, cfg).select(F.col("place_id").alias("goal"), "node_id", F.col("seconds").alias("out_s"), F.col("metres").alias("out_m")))
    ways = snapshot(asked.select("origin", "goal").distinct().join(out, "goal"))
    reached = ways.select("origin", "goal").distinct().withColumn("best", F.lit(None).cast("double"))
    frontier = state
    while True:
        fresh = frontier.select("origin", "node_id", "time").join(ways, ["origin", "node_id"]).groupBy("origin", "goal").agg(F.min(F.col("time") + F.col("out_s")).alias("now"))
        reached = snapshot(reached.join(fresh, ["origin", "goal"], "left").select("origin", "goal", F.least("best", "now").alias("best")))
        bound = reached.groupBy("origin").agg(F.when(F.count("best") == F.count(F.lit(1)), F.max("best")).alias("bound"))
        board = frontier.select("origin", "node_id", "time").join(usable, "node_id").select("origin", "route_id", "pos", F.struct((F.col("time") - F.col("t")).alias("head"), F.col("node_id").alias("at"), F.col("m").alias("m0"), F.col("t").alias("t0")).alias("b"))
        touched = board.select("origin", "route_id").distinct()
        rides = touched.join(usable, "route_id").join(board, ["origin", "route_id", "pos"], "left")
        w = Window.partitionBy("origin", "route_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rides = rides.withColumn("on", F.min("b").over(w)).where("on IS NOT NULL AND on.at <> node_id")
        ridden = rides.select("origin", "node_id", (F.col("on.head") + F.col("t")).alias("time"), *label(F.col("on.at"), "bus", F.col("line_id"), F.col("m") - F.col("on.m0"), F.col("t") - F.col("on.t0")))
        walked = frontier.select("origin", F.col("node_id").alias("from_node"), "time").join(walks, "from_node").select(
            "origin", F.col("to_node").alias("node_id"), (F.col("time") + F.col("seconds")).alias("time"), *label(F.col("from_node"), "walk", none.cast(line_type), F.col("metres"), F.col("seconds"))
        )
        offers = ridden.union(walked).groupBy("origin", "node_id").agg(F.min_by(F.struct(*cols), F.struct("time", "mode", "prev")).alias("o")).select("origin", "node_id", "o.*")
        known = state.select("origin", "node_id", F.col("time").alias("was"))
        open_ = offers.join(known, ["origin", "node_id"], "left").where("was IS NULL OR time < was - 1e-9").drop("was")
        frontier = snapshot(open_.join(bound, "origin", "left").where("bound IS NULL OR time <= bound").drop("bound"))
        if frontier.isEmpty():
            break
        state = snapshot(state.join(frontier.select("origin", "node_id"), ["origin", "node_id"], "left_anti").unionByName(frontier))
    # Pairs between the same places have one answer; it is traced once and handed to all of them at the end.
    way = ["origin", "goal"]
    done = ways.join(state.select("origin", "node_id", "time"), ["origin", "node_id"])
    best = snapshot(done.groupBy(*way).agg(F.min(F.struct((F.col("time") + F.col("out_s")).alias("seconds"), "node_id", "out_s", "out_m")).alias("b")).select(*way, "b.*"))
    last = best.select(*way, F.lit(0).alias("back"), F.lit("walk").alias("mode"), none.cast(line_type).alias("line_id"), F.col("node_id").alias("from_node"), none.cast("string").alias("to_node"), F.col("out_m").alias("metres"), F.col("out_s").alias("seconds"))
    legs, here = last, best.select(*way, "node_id")
    for back in count(1):
        step = snapshot(here.join(state, ["origin", "node_id"]))
        if step.isEmpty():
            break
        legs = snapshot(legs.union(step.select(*way, F.lit(back).alias("back"), "mode", "line_id", F.col("prev").alias("from_node"), F.col("node_id").alias("to_node"), "metres", F.col("step_s").alias("seconds"))))
        here = step.where("prev IS NOT NULL").select(*way, F.col("prev").alias("node_id"))
    merged = snapshot(merge_legs(legs.withColumn("leg", -F.col("back")).drop("back"), way))
    ids = asked.select("od_id", *way)
    return ids.join(best, way).select("od_id", "seconds"), ids.join(merged, way).drop(*way)


def merge_legs(legs: DataFrame, keys=("od_id",)) -> DataFrame:
    """Join consecutive bus legs of one line: sums, first start, last end. An itinerary has few legs."""
    w = Window.partitionBy(*keys).orderBy("leg")
    same = (F.col("mode") == "bus") & (F.lag("mode").over(w) == "bus") & (F.col("line_id") == F.lag("line_id").over(w))
    runs = legs.withColumn("_run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w))
    out = runs.groupBy(*keys, "_run").agg(
        F.first("mode").alias("mode"), F.first("line_id").alias("line_id"), F.min_by("from_node", "leg").alias("from_node"), F.max_by("to_node", "leg").alias("to_node"),
        F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"),
    )
    return out.withColumn("leg", F.row_number().over(Window.partitionBy(*keys).orderBy("_run")) - 1).drop("_run")


def itineraries(legs: DataFrame, leg_fares: DataFrame, headways: DataFrame, detours: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Legs with fare, headway and detour alert, and totals per pair.

    ``leg_fares``: od_id, leg, fare; ``headways``: line_id, headway_min;
    ``detours``: line_id, detour_id, status, last_confirmed_at, confirmed_count.
    The total fare is null unless every bus leg has one.
    """
    from ..functions.scalar import detour_confidence, whole_days

    alert = detours.where("status = 'active'").groupBy("line_id").agg(
        F.max_by(F.struct("detour_id", "last_confirmed_at", "confirmed_count"), F.struct("last_confirmed_at", "detour_id")).alias("d")
    ).select("line_id", "d.detour_id", detour_confidence(F.greatest(F.lit(0), whole_days(now, F.col("d.last_confirmed_at"))), F.col("d.confirmed_count")).alias("detour_confidence"))
    rich = legs.join(leg_fares, ["od_id", "leg"], "left").join(headways, "line_id", "left").join(alert, "line_id", "left")
    bus = F.col("mode") == "bus"
    totals = rich.groupBy("od_id").agg(
        F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("legs"), F.count_if(bus).alias("bus_legs"),
        F.when(
            (F.count_if(bus) > 0) & (F.count_if(bus) == F.count_if(bus & F.col("fare").isNotNull())),
            F.round(F.sum(F.when(bus, F.col("fare").cast("double"))), 2),
        ).alias("fare"),
    )
    return rich, totals
