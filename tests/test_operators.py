"""Operators against brute force on small fixtures."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from colectivo.operators import clouds, loops, ordered, polyline, quantiles, variants
from colectivo.operators.cleaning import thin
from colectivo.operators.frechet import discrete_frechet
from colectivo.operators.limiter import limit_history
from colectivo.streaming.notifications import decide


def metres(lon1, lat1, lon2, lat2):
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_slices_do_not_change_neighbours_and_sums(spark):
    rng = random.Random(1)
    rows = [(k, i, float(rng.randint(0, 9))) for k in range(2) for i in range(23)]
    df = spark.createDataFrame(rows, "k int, i bigint, v double")
    near = ordered.with_neighbours(df, ["k"], "i", ["v"], slice_rows=5)
    value = {(k, i): v for k, i, v in rows}
    for r in near.collect():
        assert r.prev1_v == value.get((r.k, r.i - 1)) and r.next1_v == value.get((r.k, r.i + 1))
    for r in ordered.running_sum(df, ["k"], "i", F.col("v"), "s", slice_rows=5).collect():
        assert r.s == sum(value[(r.k, j)] for j in range(r.i + 1))


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(2)
    data = {k: [round(rng.gauss(0, 10), 3) for _ in range(n)] for k, n in ((0, 1), (1, 10), (2, 101))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k int, v double")
    for r in quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}).collect():
        assert abs(r.m - np.quantile(data[r.k], 0.5)) < 1e-9 and abs(r.p - np.quantile(data[r.k], 0.95)) < 1e-9


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(0, i, i + 1) for i in range(10)] + [(1, 5, 6), (1, 6, 7), (1, 7, 5)]
    nodes = sorted({(g, n) for g, a, b in edges for n in (a, b)} | {(1, 99)})
    out = loops.connected_components(
        spark.createDataFrame(nodes, "g int, node bigint"), spark.createDataFrame(edges, "g int, src bigint, dst bigint"), ["g"]
    ).collect()
    want = {(g, n): (0 if g == 0 else 99 if n == 99 else 5) for g, n in nodes}
    assert {(r.g, r.node): r.component for r in out} == want


def test_frechet_matches_plain_recursion():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p, q = rng.normal(size=(rng.integers(1, 9), 2)), rng.normal(size=(rng.integers(1, 9), 2))
        best = np.zeros((len(p), len(q)))
        for i in range(len(p)):
            for j in range(len(q)):
                d = math.dist(p[i], q[j])
                before = [best[a, b] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0]
                best[i, j] = max(d, min(before)) if before else d
        assert abs(best[-1, -1] - discrete_frechet(p, q)) < 1e-12


def test_thinning_matches_a_scan(spark):
    rng = random.Random(4)
    rows, keep = [], set()
    for k in range(2):
        t, lon, track = 1_700_000_000, -66.0, []
        for i in range(60):
            track.append((k, i, lon, -17.0, t))
            t += rng.choice((2, 2, 2, 10, 40))
            lon += rng.choice((0.0, 0.00001, 0.00004))
        last = track[0]
        keep |= {(k, 0), (k, 59)}
        for p in track[1:-1]:
            if metres(last[2], last[3], p[2], p[3]) >= 5 or p[4] - last[4] >= 30:
                keep.add((k, p[1]))
                last = p
        rows += track
    df = spark.createDataFrame(rows, "k int, point_index bigint, lon double, lat double, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r.k, r.point_index) for r in thin(df, ["k"]).collect()} == keep


def test_simplify_matches_recursion(spark):
    rng = random.Random(5)
    pts = [(i * 0.001, rng.uniform(-1, 1) * 0.001) for i in range(40)]

    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def rdp(lo, hi):
        if hi - lo < 2:
            return set()
        d, at = max((far(pts[i], pts[lo], pts[hi]), -i) for i in range(lo + 1, hi))
        return {-at} | rdp(lo, -at) | rdp(-at, hi) if d > 0.0005 else set()

    df = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(pts)], "k int, point_index bigint, lon double, lat double")
    got = {r.point_index for r in polyline.simplify(df, ["k"], "point_index", 0.0005).collect()}
    assert got == {0, 39} | rdp(0, 39)


def test_limiter_history_equals_the_live_rule(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for device in range(3):
        t, singles, summaries = 0, [], []
        for i in range(60):
            t += rng.choice((600, 3600, 20_000, 90_000))
            rows.append((device, 1, device * 100 + i, t))
            want[device * 100 + i], singles, summaries = decide(t * 1_000_000, singles, summaries)
    df = spark.createDataFrame(rows, "device_id bigint, line_id bigint, event_id bigint, s bigint").withColumn("sent_at", F.timestamp_seconds("s"))
    assert {r.event_id: r.decision for r in limit_history(df).collect()} == want


def test_dbscan_matches_brute_force(spark):
    rng = random.Random(7)
    pts = [(0, i, -66.0 + rng.gauss(0, 1) * 0.0005, -17.0 + rng.gauss(0, 1) * 0.0005) for i in range(120)]
    eps, need = 20.0, 4
    near = {i: [j for j in range(120) if metres(*pts[i][2:], *pts[j][2:]) <= eps] for i in range(120)}
    core = [i for i in range(120) if len(near[i]) >= need]
    label = {}
    for i in core:
        if i in label:
            continue
        stack = [i]
        while stack:
            n = stack.pop()
            if n in label:
                continue
            label[n] = i
            if n in core:
                stack += [m for m in near[n] if m not in label]
    df = spark.createDataFrame(pts, "line_id int, place bigint, lon double, lat double").withColumns(
        {"eps": F.lit(eps), "min_samples": F.lit(need).cast("bigint"), "weight": F.lit(1).cast("bigint")}
    )
    out = clouds.dbscan(df, ["line_id", "eps", "min_samples"]).join(df.select("lon", "lat", "place"), ["lon", "lat"]).collect()
    assert {r.place: r.cluster for r in out} == {i: label.get(i) for i in range(120)}


def test_complete_linkage_keeps_apart_what_one_far_pair_divides(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 10.0), (0, 2, 3, 20.0), (0, 4, 5, 5.0)], "line_id int, a bigint, b bigint, metres double")
    members = spark.createDataFrame([(0, i) for i in range(1, 7)], "line_id int, trace_id bigint")
    got = {r.trace_id: r.cluster for r in variants.complete_linkage(pairs, members, ["line_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_spread_join_splits_both_sides(spark):
    from colectivo.operators.grid import spread_join

    a = spark.range(900).selectExpr("id AS x", "CASE WHEN id < 600 THEN 0 ELSE id END AS cx")
    b = spark.range(900).selectExpr("id AS y", "CASE WHEN id < 500 THEN 0 ELSE id END AS cx")
    total = ("count(*)", "sum(x * 7 + y)", "count(DISTINCT x, y)")
    got = spread_join(a, b, ["cx"], rows_per_key=64)
    assert got.selectExpr(*total).collect() == a.join(b, "cx").selectExpr(*total).collect()
    assert spread_join(a, b, ["cx"], None, "left_semi", 64).count() == a.join(b, "cx", "left_semi").count()


def test_outer_rings_keep_every_way(spark):
    from colectivo.sources.zones import outer_rings

    a, b = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    ways = {1: a[1:3], 2: [a[2], a[3], a[0]], 3: a[:2], 4: [*b, b[0]], 5: [(9.0, 9.0), (9.0, 8.0)], 6: [(9.0, 9.0), (8.0, 9.0)], 7: [(8.0, 9.0), (8.0, 8.0)]}
    member = "relation_id long, name string, members array<struct<type: string, ref: long, role: string>>"
    relations = spark.createDataFrame([(1, "z", [("way", i, "outer") for i in ways])], member)
    paths = spark.createDataFrame([(i, [{"lon": x, "lat": y} for x, y in w]) for i, w in ways.items()], "way_id long, path array<struct<lon: double, lat: double>>")
    rings = [{(q["lon"], q["lat"]) for q in r["path"]} for r in outer_rings(relations, paths).collect()]
    assert sorted(map(sorted, rings)) == sorted(map(sorted, [set(a), set(b), {(9.0, 9.0), (9.0, 8.0), (8.0, 9.0), (8.0, 8.0)}]))
