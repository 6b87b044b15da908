"""Figures that must grow with the input and not with its pairs, beside brute force."""

import collections
import math
import random

from pyspark.sql import functions as F

from colectivo.operators import cleaning, overlap, support, votes
from colectivo.plans import evaluation
from fixtures import Tables


def shuffled_rows(spark, run):
    """Result of ``run`` and the rows that its stages wrote into shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    none = lambda: gateway.jvm.java.util.ArrayList()

    def rows():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = rows()
    out = run()
    return out, sum(n for k, n in rows().items() if k not in before)


def most_rows(spark, df):
    """Rows of ``df`` and the greatest number of rows that a node of its plan made."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        out, made, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    while todo:
        node = todo.pop()
        rows = node.metrics().get("numOutputRows")
        made = max(made, rows.get().value() if rows.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out, made


def test_coverage_counts_traces_once_for_each_cell(spark):
    nodes, traces = 200, 200
    points = [(1, t, -66.2 + 0.00094 * i, -17.39 + 0.000001 * t) for t in range(traces) for i in range(3)]
    points += [(1, traces, -66.0, -17.0)]
    shapes = [(1, e, True, [(-66.2 + 1e-6 * e, -17.39), (-66.2 + 1e-6 * e, -17.39), (-66.2, -17.39)]) for e in range(nodes)] + [(1, nodes, True, [])]
    pts = spark.createDataFrame(points, "g int, trace_id bigint, lon double, lat double")
    shp = spark.createDataFrame(shapes, "g int, edge_id bigint, forward boolean, path array<struct<lon:double,lat:double>>")
    own = spark.createDataFrame([(1, e, True, 2, 2 * e + 1) for e in range(nodes + 1)], "g int, edge_id bigint, forward boolean, weight bigint, node bigint")
    out, moved = shuffled_rows(spark, lambda: support.localized_support(own, shp, pts, ["g"]).collect())
    low = min(p[3] for p in points)
    cell = lambda lon, lat: (math.floor(lon * math.cos(math.radians(low)) * 111320.0 / 100), math.floor(lat * 111320.0 / 100))
    at = {(t, cell(lon, lat)) for _, t, lon, lat in points}
    for r in out:
        path = shapes[r.edge_id][3]
        if path:
            cx, cy = cell(*path[len(path) // 2])
            want = len({t for t, (x, y) in at if abs(x - cx) <= 1 and abs(y - cy) <= 1})
        else:
            want = traces + 1
        assert r.coverage == want
    assert moved < 10 * (len(points) + nodes)  # nodes x traces would be 40 000


def test_latest_ballot_is_spread_once(spark):
    rng = random.Random(5)
    ballots = [(d, 1, rng.choice(["approve", "reject"]), rng.randint(0, 50), rng.choice([None, 0, 1])) for d in range(2) for _ in range(150)]
    near = [(d, 1, e, e % 2) for d in range(2) for e in range(100)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    trips = frame([(0, 1, 9), (1, 1, 9)], "device_id bigint, line_id bigint, trips bigint")
    stored = frame([(0, 0, "approve", 1000)], "route_edge_id bigint, device_id bigint, vote string, created_at bigint")
    overlaps = frame(near, "device_id bigint, line_id bigint, route_edge_id bigint, section_index int")
    for sections in (True, False):
        cast = frame(ballots, "device_id bigint, line_id bigint, vote string, created_at bigint, section_index int")
        cast = cast if sections else cast.drop("section_index")
        out, made = most_rows(spark, votes.cast_votes(stored, cast, overlaps, trips))
        want = {}
        for d, line, e, at in near:
            heard = [(c, v) for o, _, v, c, section in ballots if o == d and (not sections or section in (None, at))]
            want[e, d] = max(heard + ([(1000, "approve")] if (e, d) == (0, 0) else []))
        assert {(r.route_edge_id, r.device_id): (r.created_at, r.vote) for r in out} == want
        assert made <= 6 * len(near)  # each ballot on each edge would be 30 000


def test_sections_search_edges_once(spark, monkeypatch):
    import catalog

    catalog.load()
    calls, search = [], overlap.overlapping
    monkeypatch.setattr(overlap, "overlapping", lambda *a, **k: calls.append(a) or search(*a, **k))
    folder = "/root/testdata/sf0.001"
    out = catalog.QUERIES["w04_voteable_sections"](spark, folder)
    assert len(calls) == 1
    traces = Tables(spark, folder).trace_points.select("trace_id").distinct().count()
    assert out.select("device_id").distinct().count() == traces and out.where("trips <> 1").isEmpty()


def test_despiked_shapes_move_few_copies(spark):
    rng = random.Random(6)
    at = lambda: (-66.2 + rng.random() * 0.004, -17.39 + rng.random() * 0.004)
    points = [(t, *at()) for t in range(3) for _ in range(60)]
    shapes = [(t, s, v, *at()) for t in range(3) for s in range(40) for v in range(4)]
    pts = spark.createDataFrame(points, "trace_id bigint, lon double, lat double")
    shp = spark.createDataFrame(shapes, "trace_id bigint, seq bigint, vertex bigint, lon double, lat double")
    out, moved = shuffled_rows(spark, lambda: cleaning.despike_edge_shapes(shp, pts, ["trace_id"]).collect())
    want = set()
    for t in range(3):
        mine = [(lon, lat) for o, lon, lat in points if o == t]
        k = math.cos(math.radians(min(lat for _, lat in mine))) * 111320.0
        for s in range(40):
            verts = [r for r in shapes if r[:2] == (t, s)]
            near = {r[2] for r in verts if any(math.hypot((r[3] - x) * k, (r[4] - y) * 110540.0) <= 30 for x, y in mine)}
            want |= {(t, s, r[2]) for r in verts if r[2] in near or len(near) < 2}
    assert {(r.trace_id, r.seq, r.vertex) for r in out} == want
    assert moved < 8 * (len(shapes) + len(points))  # nine copies of each vertex alone were 4 320


def test_clipping_keeps_no_row_of_each_trace_and_sample(spark):
    traces, end = 150, 6
    points = [(1, t, i, -66.2 + 0.0009 * i, -17.39) for t in range(traces) for i in range(1, end - (t > 0))] + [(2, 0, 0, 0.0, 0.0), (2, 0, 1, 0.001, 0.0)]
    truth = [(line, [(-66.2 + 0.0009 * i, -17.39) for i in range(end)]) for line in (1, 2)]
    pts = spark.createDataFrame(points, "line_id bigint, trace_id bigint, point_index bigint, lon double, lat double")
    whole = spark.createDataFrame(truth, "line_id bigint, path array<struct<lon:double,lat:double>>")
    clip = lambda n: evaluation.clip_to_seen(whole, pts, ["line_id"], min_traces=n, step_m=2.0)
    out, moved = shuffled_rows(spark, lambda: clip(2).collect())
    lon = {r.line_id: [p.lon for p in r.path] for r in out}
    assert -66.2 + 0.0009 - 0.0003 <= lon[1][0] <= -66.2 + 0.0009 and -66.2 + 0.0036 <= lon[1][-1] <= -66.2 + 0.0036 + 0.0003 and len(lon[2]) == end
    assert [[p.lon for p in r.path] for r in clip(3).collect() if r.line_id == 1][0] == lon[1]
    assert [r for r in clip(1).collect() if r.line_id == 1][0].path[-1].lon > lon[1][-1] + 0.0005
    assert moved < 12 * len(points)  # a row of each sample and trace would be about 25 000


def test_points_are_numbered_once(spark):
    points = Tables(spark, "/root/testdata/sf0.001").trace_points
    out, moved = shuffled_rows(spark, lambda: points.select("trace_id", "point_index").collect())
    assert len(set(out)) == len(out) > 0 and moved == 0  # numbered anew, each row crossed several shuffles


def test_spots_stand_for_their_points(spark):
    """Weighted spots give what the points give, and no candidate holds a copy of each point."""
    from colectivo.operators import clouds
    from colectivo.plans import strategies

    rng = random.Random(4)
    rows = [(rng.randint(0, 1), t, i, -66.2 + 0.001 * rng.randint(0, 5), -17.4 + 0.001 * rng.randint(0, 3)) for t in range(50) for i in range(40)]
    points = spark.createDataFrame(rows, "line_id int, trace_id bigint, point_index bigint, lon double, lat double")
    spots = strategies._spots(points)
    keys = ["line_id", "eps"]
    each = spots.crossJoin(spark.range(1, 9).selectExpr("double(id) AS eps"))
    labels = each.selectExpr("line_id", "eps", "lon", "lat", "CASE WHEN weight % 7 > 0 THEN bigint(weight % 3) END AS cluster")
    plain = clouds.cluster_stats(points.join(labels.select(*keys).distinct(), "line_id"), labels, keys).collect()
    out, made = most_rows(spark, clouds.spot_stats(spots, labels, ["line_id"], keys))
    facts = lambda r: (r.points, round(r.lon, 9), round(r.lat, 9), round(r.mean_index, 9))
    assert {(r.line_id, r.eps, r.cluster): facts(r) for r in out} == {(r.line_id, r.eps, r.cluster): facts(r) for r in plain} and out
    assert made <= 2 * len(rows)  # a copy of each point for each candidate would be 16 000


def test_subscribers_are_dealt_to_many_tasks(spark, monkeypatch):
    """All reports of one line in one file: no task makes more than a few slices' pairs, and none is lost."""
    from colectivo.operators import listings

    monkeypatch.setattr(listings, "SLICE", 32)
    monkeypatch.setattr(listings, "PAIRS_PER_TASK", 4096)
    reports = spark.createDataFrame([(i, 1, i % 90 if i % 4 else None) for i in range(400)], "report_id long, line_id long, reporter long").coalesce(1)
    subs = spark.createDataFrame([(1, d) for d in range(100)] + [(1, 5), (2, 7)], "line_id long, device_id long")
    devices = spark.createDataFrame([(d, "t" if d % 10 else None) for d in range(100)], "device_id long, push_token string")
    out = listings.subscribers(reports, subs, devices).select("report_id", "device_id", F.spark_partition_id().alias("p")).collect()
    want = sorted((r, d) for r in range(400) for d in [*range(100), 5] if d % 10 and not (r % 4 and r % 90 == d))
    assert sorted((r.report_id, r.device_id) for r in out) == want
    tasks = collections.Counter(r.p for r in out)
    assert len(tasks) > 5 and max(tasks.values()) < len(want) / 2  # one task made all of them


def test_pair_tests_copy_no_vertices(spark):
    """Pairs judged by blocks equal those of the rule in SQL, and vertices cross shuffles per block, not per pair."""
    from colectivo.operators import variants
    from colectivo.session import snapshot

    rng = random.Random(8)
    lane = lambda a, b, y, off: [(25.0 * i, y + rng.uniform(-9, 9) + (off if 30 < i < 30 + off / 40 else 0.0)) for i in range(a, b)]
    tracks = [lane(rng.randint(0, 20), rng.randint(60, 90), 190.0 * (k % 3), rng.choice([0.0, 150.0, 300.0, 600.0])) for k in range(40)]
    rows = [(0, k, [(x / 111_320.0, y / 111_320.0) for x, y in path]) for k, path in enumerate(tracks)] + [(0, 90, [(0.0, 0.0)]), (0, 91, [])]
    shapes = snapshot(spark.createDataFrame(rows, "line_id int, trace_id int, path array<struct<lon: double, lat: double>>"))
    out, moved = shuffled_rows(spark, lambda: variants.compatible_pairs(shapes, ["line_id"]).collect())
    every = spark.createDataFrame([(0, a, b) for a in range(40) for b in range(40) if a != b], "line_id int, a int, b int")
    named = lambda name: shapes.where("size(path) > 1").selectExpr("line_id", f"trace_id AS {name}", "path")
    ref = shapes.selectExpr("line_id", "array_min(transform(path, p -> p.lat)) AS lat").groupBy("line_id").agg(F.min("lat").alias("ref_lat"))
    one = {(r.a, r.b) for r in variants.stays_with(every, named("a"), named("b"), ref, ["line_id"]).collect()}
    want = {(a, b) for a, b in one if a < b and (b, a) in one}
    assert {(r.a, r.b) for r in out} == want and 100 < len(want) < 780
    assert moved < 10 * 780 < sum(map(len, tracks)) * 40  # a row of each vertex and pair was over 100 000


def test_slices_of_subscribers_grow_with_the_pairs():
    """Each row is copied to every slice of the other side; 60 times sf0.1 has about 6e6 reports and 8.2e5 subscribers on five lines."""
    from colectivo.operators.listings import slices

    lines, people = 1_200_000, 164_000
    tasks, rows = slices(5.0 * lines * people)
    copies = 5 * (lines * math.ceil(people / rows) + people * math.ceil(lines / rows))
    assert copies < 200_000_000  # 964 000 000 with slices of 2 048 rows
    assert rows * rows <= 5.0 * lines * people / tasks
    assert slices(1000.0) == (1, 2048)


def test_subscribers_are_whole_in_larger_slices(spark, monkeypatch):
    from colectivo.operators import listings

    monkeypatch.setattr(listings, "SLICE", 3)
    monkeypatch.setattr(listings, "PAIRS_PER_TASK", 200)
    monkeypatch.setattr(listings, "MOST_TASKS", 8)
    reports = spark.range(60).selectExpr("id AS report_id", "id % 2 AS line_id", "id % 7 AS reporter")
    subs = spark.range(80).selectExpr("id % 2 AS line_id", "id AS device_id")
    devices = spark.range(80).selectExpr("id AS device_id", "IF(id % 5 = 0, NULL, 't') AS push_token")
    got = sorted((r["report_id"], r["device_id"]) for r in listings.subscribers(reports, subs, devices).collect())
    assert listings.slices(2400.0)[1] > 3
    assert got == sorted((r, d) for r in range(60) for d in range(80) if r % 2 == d % 2 and d % 5 and d != r % 7)


def test_streams_read_their_table_once(spark):
    from catalog import streams

    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return i

    rows = spark.range(600).select(F.udf(seen, "long")("id").alias("id"), F.timestamp_seconds(F.col("id")).alias("at"))
    out = streams.feed(Tables(spark, ""), rows, "at", lambda stream: stream)
    assert sorted(r["id"] for r in out.collect()) == list(range(600))
    assert read.value == 600  # 4 800 before: for the quantiles and for each span
    files = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in files  # the state of votes alone is kept on disk


def test_large_spans_of_a_stream_come_in_more_tasks(spark, monkeypatch):
    from catalog import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    rows = spark.range(600).select("id", F.timestamp_seconds(F.col("id")).alias("at"))
    sizes = []
    streams.feed(Tables(spark, ""), rows, "at", lambda stream: stream, lambda batch, number: sizes.append((batch.count(), batch.rdd.getNumPartitions())))
    assert sum(n for n, _ in sizes) == 600 and len(sizes) == 6
    assert all(abs(n - 100) <= 2 for n, _ in sizes)
