"""The run of steps: order, failures, parts; and the real steps on the smallest tables."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from catalog.nightly import NOW, platform
from colectivo.plans import nightly
from colectivo.plans.nightly import Change, Step
from fixtures import Tables


def tables(spark):
    return {"a": spark.range(4).selectExpr("id AS line_id", "id * 2 AS v"), "b": spark.range(2).selectExpr("id AS k")}


def test_order_failure_and_touched_lines(spark):
    seen = []

    def step(name, fail=False):
        def work(t, touched, now, add=1):
            seen.append((name, sorted(r.line_id for r in touched.collect())))
            if fail:
                raise RuntimeError("no")
            return Change({"a": t["a"].withColumn("v", F.col("v") + add)}, t["a"].where(f"line_id = {len(seen)}").select("line_id"), t["a"].agg(F.sum("v").alias("sum")))
        return Step(name, work, {"x": (), "y": ("x",), "z": ("y",)}[name], ("a",))

    steps = [step("z"), step("x"), step("y", fail=True)]
    done = nightly.run(tables(spark), F.lit(NOW), steps, only=["x", "y", "z", "other"], params={"z": {"add": 10}})
    assert seen == [("x", []), ("y", [1]), ("z", [1])] and done.status == "failed"
    log = {r.step: r for r in done.log.collect()}
    assert [log[s].status for s in "xyz"] == ["completed", "failed", "completed"] and "no" in log["y"].error
    assert log["x"].counts == {"sum": 12} and log["z"].counts == {"sum": 16}
    assert sorted(r.v for r in done.tables["a"].collect()) == [11, 13, 15, 17]
    assert sorted(r.line_id for r in done.touched.collect()) == [1, 3]
    seen.clear()
    stopped = nightly.run(tables(spark), F.lit(NOW), steps, stop_on_error=True)
    assert [r.step for r in stopped.log.orderBy("place").collect()] == ["x", "y"] and sorted(r.v for r in stopped.tables["a"].collect()) == [1, 3, 5, 7]
    seen.clear()
    assert nightly.run(tables(spark), F.lit(NOW), steps, only=["x", "z"]).status == "completed" and seen == [("x", []), ("z", [1])]


def test_steps_side_by_side_and_their_tables(spark):
    both = threading.Barrier(2, timeout=60)  # passes only if two steps run at once

    def waits(table):
        def work(t, touched, now):
            both.wait()
            return Change({table: t[table]})
        return work

    run = nightly.run(tables(spark), F.lit(NOW), [Step("x", waits("a"), (), ("a",)), Step("y", waits("b"), (), ("b",))])
    assert run.status == "completed" and run.changed == {"a", "b"}
    with pytest.raises(ValueError, match="no order"):
        nightly.run(tables(spark), F.lit(NOW), [Step("x", waits("a"), (), ("a",)), Step("y", waits("a"), (), ("a",))])
    stray = nightly.run(tables(spark), F.lit(NOW), [Step("x", lambda t, touched, now: Change({"b": t["b"]}), (), ("a",))])
    assert stray.status == "failed" and "doesn't own" in stray.log.first().error


def test_parts_of_untouched_lines_stay(spark, tmp_path):
    first = tables(spark)
    run = lambda t, hit: nightly.Run(t, hit.select("line_id"), "completed", None, set())
    wrote = {r["name"]: r.parts for r in nightly.publish(run(first, first["a"]), str(tmp_path), parts=4).collect()}
    assert wrote["b"] == 1 and 1 < wrote["a"] <= 4
    later = {"a": first["a"].withColumn("v", F.lit(99).cast("bigint")), "b": first["b"]}
    wrote = {r["name"]: r.parts for r in nightly.publish(run(later, first["a"].where("line_id = 2")), str(tmp_path), parts=4).collect()}
    assert wrote == {"a": 1, "b": 0}
    part = F.pmod(F.xxhash64("line_id"), F.lit(4))
    mine = {r.line_id for r in first["a"].where(part == part).withColumn("p", part).join(first["a"].where("line_id = 2").select(part.alias("p")), "p").collect()}
    back = nightly.published(spark, str(tmp_path), ["a", "b"])
    assert {r.line_id: r.v for r in back["a"].collect()} == {i: 99 if i in mine else 2 * i for i in range(4)}
    assert nightly.publish(run(later, first["a"].limit(0)), str(tmp_path), parts=4).agg(F.sum("parts")).first()[0] == 0


def test_merge_chains_end_at_lines_that_stay(spark):
    merges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 7)], "line_id long, target long")
    assert {r.target for r in nightly.final_targets(merges).collect()} == {20}


def test_stored_routes_have_edges_streets_and_zones(spark):
    """New versions get their edges in order, the streets along them and the zones of both ends."""
    t = platform(Tables(spark, "/root/testdata/sf0.001"))
    fresh = t["routes"].where("ramal_label = 'main' AND line_id = 2").select("route_id", "line_id", "ramal_label", "path")
    cut, stored = nightly.stored_routes(fresh, t)
    path = fresh.first().path
    edges = sorted(cut.collect(), key=lambda r: r.sequence)
    assert [e.edge_id for e in edges if e.edge_id < 500_000] == sorted(e.edge_id for e in edges if e.edge_id < 500_000)
    assert edges[0].path[0] == path[0] and edges[-1].path[-1] == path[-1]
    assert all(a.path[-1] == b.path[0] for a, b in zip(edges, edges[1:]))
    row = stored.first()
    names = row.street_summary.split(" - ")
    assert names[0] == "Calle 0" and names == sorted(set(names), key=lambda s: int(s.split()[1]))
    assert row.first_zone_id is None and row.last_zone_id is not None  # the route begins on a zone's border
