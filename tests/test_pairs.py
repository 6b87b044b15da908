"""Pairs of traces beside brute force."""

import numpy as np

from colectivo.operators.frechet import close_pairs, discrete_frechet, frechet_within


def test_frechet_of_many_pairs_at_once():
    rng = np.random.default_rng(1)
    walk = lambda n: np.cumsum(rng.normal(size=(n, 2)), 0)
    p = [walk(n) for n in rng.integers(1, 30, 200)]
    q = [t + rng.normal(size=t.shape) if i % 2 else walk(int(rng.integers(1, 30))) for i, t in enumerate(p)]
    want = np.array([discrete_frechet(a, b) for a, b in zip(p, q)])
    columns = lambda tracks: [(t[:, 0], t[:, 1]) for t in tracks]
    for limit in (np.inf, 6.0, 3.0, 0.01):
        assert (frechet_within(columns(p), columns(q), limit) == np.where(want <= limit, want, np.inf)).all()


def test_close_pairs_across_blocks(spark, monkeypatch):
    from colectivo.operators import frechet

    monkeypatch.setattr(frechet, "BLOCK", 8)
    rng = np.random.default_rng(2)
    tracks = {(k % 2, k): [(0.0002 * i, 0.0001 * rng.random() + 0.0015 * (k % 3)) for i in range(int(rng.integers(20, 26)))] for k in range(60)}
    shapes = spark.createDataFrame([(g, k, path) for (g, k), path in tracks.items()], "line_id int, trace_id int, path array<struct<lon: double, lat: double>>")
    got = {(r.line_id, r.a, r.b): r.metres for r in close_pairs(shapes, ["line_id"], 60.0).collect()}
    flat = lambda path: np.radians(np.array(path)) * 6371000.0
    want = {(g, a, b): discrete_frechet(flat(tracks[g, a]), flat(tracks[h, b])) for g, a in tracks for h, b in tracks if g == h and a < b}
    want = {k: d for k, d in want.items() if d <= 60.0}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 0.01 for k in want)


def test_direction_parts_equal_all_pairs(spark):
    from pyspark.sql import functions as F

    from colectivo.operators import variants
    from colectivo.operators.loops import connected_components
    from test_growth import shuffled_rows

    rng = np.random.default_rng(3)
    edges = {(1, t): sorted(rng.choice(90, int(rng.integers(1, 22)), replace=False) + 100 * (t % 5)) for t in range(40)}
    edges |= {(2, t): [e for e in range(60) if rng.random() > 0.05] for t in range(100, 220)}
    frame = spark.createDataFrame([(g, t, int(e), True) for (g, t), es in edges.items() for e in es], "line_id int, trace_id int, edge_id int, forward boolean")
    frame = frame.repartition(4).localCheckpoint()
    sizes = frame.groupBy("line_id", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    enough = (F.col("shared") >= 5) | (F.col("shared") / F.col("n") >= 0.3)
    needs = sizes.withColumn("need", F.expr("cast(least(5, ceil(n * 0.3D)) as int)")).drop("n")
    links, moved = shuffled_rows(spark, lambda: variants.linked_by_edges(frame, needs, enough, sizes).localCheckpoint())
    got = {(r.line_id, r.trace_id): r.component for r in connected_components(sizes, links, ["line_id"], "trace_id").collect()}
    part = {k: k[1] for k in edges}
    linked = [(a, b) for a in edges for b in edges if a != b and a[0] == b[0] and (s := len(set(edges[a]) & set(edges[b]))) and (s >= 5 or s / len(edges[a]) >= 0.3)]
    while any(part[a] != part[b] for a, b in linked):
        for a, b in linked:
            part[a] = part[b] = min(part[a], part[b])
    assert got == part and len(set(part.values())) > 5
    assert moved < 40 * sum(map(len, edges.values()))  # shared edges of all pairs in line 2 alone were 770 000 rows


def test_compatible_parts_equal_those_of_all_pairs(spark, monkeypatch):
    from colectivo.operators import variants
    from colectivo.operators.loops import connected_components

    lane = lambda a, b, y: [(25.0 * i, y) for i in range(a, b)]
    tracks = [lane(0, 40 + k, 3.0 * k) for k in range(12)] + [lane(0, 11, 900.0), lane(0, 80, 900.0), lane(40, 110, 900.0), lane(60, 99, 1000.0), lane(0, 30, 5000.0)]
    rows = [(0, k, [(x / 111_320.0, y / 111_320.0) for x, y in path]) for k, path in enumerate(tracks)]
    shapes = spark.createDataFrame(rows, "line_id int, trace_id int, path array<struct<lon: double, lat: double>>")
    all_pairs = variants.compatible_pairs(shapes, ["line_id"]).selectExpr("line_id", "a AS src", "b AS dst").localCheckpoint()
    want = {r.trace_id: r.component for r in connected_components(shapes, all_pairs, ["line_id"], "trace_id").collect()}
    tested, judge = [], variants._mutual
    monkeypatch.setattr(variants, "_mutual", lambda found, *a: tested.append(found.count()) or judge(found, *a))
    got = {r.trace_id: r.component for r in variants.compatible_parts(shapes, ["line_id"]).collect()}
    assert got == want and 3 <= len(set(want.values())) < len(tracks)
    assert sum(tested) < all_pairs.count() / 2  # all pairs were tested before
