"""Travel times against Dijkstra, pair compatibility and endpoints against plain Python."""

from __future__ import annotations

import collections
import heapq
import math

import numpy as np
from pyspark.sql import functions as F

from colectivo.operators import variants
from colectivo.operators.intervals import inside_spans
from colectivo.operators.polyline import project
from colectivo.plans import routing


def test_travel_times_equal_dijkstra(spark):
    rng = np.random.default_rng(3)
    spots = {f"n{i}": (-66.2 + 0.004 * (i % 6), -17.4 + 0.004 * (i // 6)) for i in range(30)}
    stops = []
    for route in range(8):
        t = 0.0
        for pos, n in enumerate(rng.choice(30, 7, replace=False)):
            stops.append((f"r{route}", route, pos, f"n{n}", t, 4.17 * t, route != 7, route != 6))
            t += float(rng.uniform(60, 400))
    rows = [(n, *at, [0]) for n, at in spots.items()]
    nodes = spark.createDataFrame(rows, "node_id string, lon double, lat double, lines array<int>")
    walks = [(f"n{a}", f"n{b}", 100.0, float(rng.uniform(100, 900))) for a, b in rng.choice(30, (20, 2)) if a != b]
    pairs = [(k, *(float(v) for v in (-66.2 + 0.02 * rng.random(), -17.4 + 0.016 * rng.random(), -66.2 + 0.02 * rng.random(), -17.4 + 0.016 * rng.random()))) for k in range(12)]
    pairs += [(k + 12, pairs[k][1], pairs[k][2], *pairs[(k + 5) % 12][3:]) for k in range(12)] + [(90, *pairs[0][1:3], 0.0, 0.0), (91, 0.0, 0.0, *pairs[0][3:])]
    hav = lambda a, b: 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2))
    links, by_route = collections.defaultdict(list), collections.defaultdict(list)
    for r, _, pos, n, t, _, line_ok, route_ok in stops:
        if line_ok and route_ok:
            by_route[r].append((pos, n, t))
    for seq in by_route.values():
        for i, (_, a, ta) in enumerate(seq):
            for _, b, tb in seq[i + 1 :]:
                links[a].append((b, tb - ta))
    for a, b, _, s in walks:
        links[a].append((b, s))
    near = lambda p: [(n, hav(p, at) / 1.39) for n, at in spots.items() if hav(p, at) <= 800]
    want = {}
    for k, olon, olat, dlon, dlat in pairs:
        best, heap = {}, [(s, n) for n, s in near((olon, olat))]
        heapq.heapify(heap)
        while heap:
            t, n = heapq.heappop(heap)
            if n not in best:
                best[n] = t
                for b, s in links[n]:
                    heapq.heappush(heap, (t + s, b))
        ends = [best[n] + s for n, s in near((dlon, dlat)) if n in best]
        if ends:
            want[k] = min(ends)
    stop_rows = spark.createDataFrame(stops, "route_id string, line_id int, pos int, node_id string, t double, m double, line_approved boolean, route_confirmed boolean")
    transfers = spark.createDataFrame(walks, "from_node string, to_node string, metres double, seconds double")
    od = spark.createDataFrame(pairs, "od_id int, olon double, olat double, dlon double, dlat double")
    totals, legs = routing.travel_times(od, nodes, stop_rows, transfers)
    got = {r.od_id: r.seconds for r in totals.collect()}
    assert got.keys() == want.keys() and 90 not in got and 91 not in got
    assert all(abs(got[k] - want[k]) < 1e-3 * want[k] + 0.01 for k in want)
    assert {r.od_id: r.s for r in legs.groupBy("od_id").agg(F.sum("seconds").alias("s")).collect()}.keys() == want.keys()


def test_pairs_between_the_same_places_are_traced_once(spark, monkeypatch):
    nodes = spark.createDataFrame([("a", 0.0, 0.0, [1]), ("b", 0.1, 0.0, [1])], "node_id string, lon double, lat double, lines array<int>")
    stops = spark.createDataFrame([(1, 1, 0, "a", 0.0, 0.0, True, True), (1, 1, 1, "b", 600.0, 9000.0, True, True)],
                                  "route_id int, line_id int, pos int, node_id string, t double, m double, line_approved boolean, route_confirmed boolean")
    walks = spark.createDataFrame([], "from_node string, to_node string, metres double, seconds double")
    pairs = spark.createDataFrame([(k, 0.0, 0.001, 0.1, 0.001) for k in range(300)], "od_id int, olon double, olat double, dlon double, dlat double")
    merged, merge = [], routing.merge_legs
    monkeypatch.setattr(routing, "merge_legs", lambda legs, *a: merged.append(legs.count()) or merge(legs, *a))
    times, legs = routing.travel_times(pairs, nodes, stops, walks)
    assert {(r.od_id, r["count"]) for r in legs.groupBy("od_id").count().collect()} == {(k, 3) for k in range(300)}
    assert times.count() == 300 and set(legs.columns) == {"od_id", "leg", "mode", "line_id", "from_node", "to_node", "metres", "seconds"}
    assert merged == [3]  # the legs of each pair were 900


def test_compatible_pairs_equal_plain_rule(spark):
    """Evenly spaced tracks of several kinds: each pair judged vertex by vertex in plain Python."""
    lat = lambda m: m / 111_320.0
    tracks = {
        1: [(25.0 * i, 0.0) for i in range(80)], 2: [(25.0 * i, 150.0) for i in range(80)], 3: [(25.0 * i, 230.0) for i in range(80)],
        4: [(25.0 * i, 0.0) for i in range(30)], 5: [(25.0 * i, 0.0) for i in range(11)], 6: [(25.0 * i, 0.0) for i in range(40, 120)],
        7: [(25.0 * i, 0.0 if i < 30 or i > 45 else 400.0) for i in range(80)], 8: [(500.0, 25.0 * i - 1000) for i in range(80)],
        9: [(25.0 * i, 0.0 if i < 50 else 25.0 * (i - 50)) for i in range(80)],
    }
    rows = [(0, k, [(x / 111_320.0, lat(y)) for x, y in path]) for k, path in tracks.items()]
    shapes = spark.createDataFrame(rows, "line_id int, trace_id int, path array<struct<lon: double, lat: double>>")
    got = {(r.a, r.b) for r in variants.compatible_pairs(shapes, ["line_id"]).collect()}

    def stays(a, b):
        seg = np.array(b)
        p, q = seg[:-1], seg[1:]
        size = np.hypot(*(q - p).T)
        pos = np.concatenate([[0], np.cumsum(size)])
        near = {}
        for k, v in enumerate(np.array(a)):
            t = np.clip(((v - p) * (q - p)).sum(1) / np.maximum(size**2, 1e-12), 0, 1)
            d = np.hypot(*(p + t[:, None] * (q - p) - v).T)
            if d.min() <= 200:
                near[k] = pos[d.argmin()] + t[d.argmin()] * size[d.argmin()]
        if len(near) * 25 < 300:
            return False
        ks = sorted(near)
        away = max((y - x - 1 for x, y in zip(ks, ks[1:])), default=0)
        head = ks[0] * 25 <= 250 or near[ks[0]] <= 250
        tail = (len(a) - 1 - ks[-1]) * 25 <= 250 or pos[-1] - near[ks[-1]] <= 250
        return away * 25 <= 250 and head and tail

    want = {(a, b) for a in tracks for b in tracks if a < b and stays(tracks[a], tracks[b]) and stays(tracks[b], tracks[a])}
    assert got == want and 0 < len(want) < 36


def test_nearest_segment_without_a_radius(spark):
    rng = np.random.default_rng(1)
    seg = [(g, i, *map(float, rng.uniform(-20_000, 20_000, 2))) for g in range(3) for i in range(20)]
    lines = [(g, i, x, y, x + 50.0, y + 30.0, 0.0, math.hypot(50, 30)) for g, i, x, y in seg] + [(0, 99, *seg[0][2:], seg[0][2] + 50.0, seg[0][3] + 30.0, 0.0, math.hypot(50, 30))]
    points = [(g, i, *map(float, rng.uniform(-60_000, 60_000, 2))) for g in range(4) for i in range(25)] + [(0, 900, None, 1.0), (0, 901, *seg[0][2:])]
    s = spark.createDataFrame(lines, "g int, seg int, x1 double, y1 double, x2 double, y2 double, pos double, len double")
    p = spark.createDataFrame(points, "g int, id int, px double, py double")
    got = {(r.g, r.id): (round(r.offset_m, 6), r.seg) for r in project(p, s, ["g"], None, ["id"]).collect()}

    def best(px, py, rows):
        def d(r):
            t = min(1.0, max(0.0, ((px - r[2]) * 50 + (py - r[3]) * 30) / (50 * 50 + 30 * 30)))
            return math.hypot(px - r[2] - 50 * t, py - r[3] - 30 * t)
        return min((round(d(r), 6), r[1]) for r in rows)

    assert got == {(g, i): best(px, py, [r for r in lines if r[0] == g]) for g, i, px, py in points if g < 3 and px is not None}


def test_positions_inside_spans(spark):
    rng = np.random.default_rng(2)
    spans = [(k % 2, k, int(lo), int(lo + w)) for k, (lo, w) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(-2, 90, 60)))] + [(0, 60, 0, 5000)]
    at = [(g, t, int(s)) for g in (0, 1) for t, s in enumerate(rng.integers(-20, 700, 200))]
    got = inside_spans(spark.createDataFrame(at, "g int, t int, seq int"), spark.createDataFrame(spans, "g int, branch int, lo int, hi int"), ["g"])
    rows = [(r.g, r.t, r.branch) for r in got.collect()]
    want = {(g, t, b) for g, t, s in at for h, b, lo, hi in spans if g == h and lo <= s <= hi}
    assert len(rows) == len(want) and set(rows) == want
