"""Quadtree joins against brute force, and the size of their largest task under crowding."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colectivo.operators import quadtree
from colectivo.operators.quadtree import LEAF, METRES


def table(spark, x, y, names):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} double, {names[2]} double")


def near(left, right, reach, limit):
    out = quadtree.near_pairs(left, right, (F.col("x"), F.col("y")), (F.col("p"), F.col("q")), F.lit(float(reach)), rows_per_leaf=limit)
    return out.where((F.col("x") - F.col("p")) ** 2 + (F.col("y") - F.col("q")) ** 2 <= float(reach) ** 2)


@pytest.mark.parametrize("limit", [7, 60, 10**6])
def test_near_pairs_equal_brute_force(spark, limit):
    rng = np.random.default_rng(limit)
    spots = rng.uniform(-3000, 3000, (300, 2))
    spots[:90] = spots[0] + rng.normal(0, 15, (90, 2))  # a crowd in a few cells
    spots[90:150] = spots[0]  # and one on a single spot
    other = np.vstack([rng.uniform(-3000, 3000, (150, 2)), spots[:40] + rng.normal(0, 60, (40, 2))])
    got = near(table(spark, *spots.T, "ixy"), table(spark, *other.T, "jpq"), 120, limit).select("i", "j").collect()
    gap = ((spots[:, None] - other[None]) ** 2).sum(-1)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(gap <= 120.0**2))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("limit", [5, 10**6])
@pytest.mark.parametrize("grow", [0.0, 0.01])
def test_box_pairs_equal_brute_force(spark, limit, grow):
    rng = np.random.default_rng(2)
    at, size = rng.uniform(-0.4, 0.4, (120, 2)), rng.exponential(0.02, (120, 2))
    size[:5] = 0.5  # boxes over all others
    at[60:80], size[60:80] = at[60], size[60]  # copies
    rows = [(i % 2, i, float(a), float(a + u), float(b), float(b + v)) for i, ((a, b), (u, v)) in enumerate(zip(at, size))]
    boxes = spark.createDataFrame(rows, "g int, id long, w double, e double, s double, n double")
    got = [(r.g, r.a, r.b) for r in quadtree.box_pairs(boxes, ["g"], "id", grow, rows_per_leaf=limit).collect()]
    meet = lambda p, q: p[2] - grow <= q[3] and q[2] - grow <= p[3] and p[4] - grow <= q[5] and q[4] - grow <= p[5]
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and meet(p, q)}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("crowded", ["left", "right"])
@pytest.mark.parametrize("spread", [0.0, 150.0])
def test_task_size_under_crowding(spark, crowded, spread):
    """10^5 points of one side in one 400 m cell, or on one spot: no leaf and slice holds more than the stated rows."""
    limit, m = 2_000, 100_000
    many = spark.range(m).selectExpr("id AS i", f"100.0D + {spread} * (id % 317) / 317 AS x", f"100.0D + {spread} * (id % 211) / 211 AS y")
    few = spark.range(40).selectExpr("id AS j", "100.0D + id AS p", "100.0D + id AS q")
    tree = quadtree.build([(many, F.col("x"), F.col("y"))] + [(few, F.col("p"), F.col("q"))], (), METRES, limit)
    placed = quadtree.place(tree, many, F.col("x"), F.col("x"), F.col("y"), F.col("y"))
    sizes = placed.groupBy(*LEAF).count().agg(F.max("count"), F.sum("count"), F.count(F.lit(1))).first()
    assert sizes[1] == m and sizes[0] <= 1.3 * limit and sizes[2] >= m / limit / 2
    if crowded == "left":
        pairs = near(many, few, 400, limit)
    else:
        pairs = near(few.toDF("i", "x", "y"), many.toDF("j", "p", "q"), 400, limit)
    assert pairs.count() == 40 * m


def test_empty_sides(spark):
    none, one = table(spark, [], [], "ixy"), table(spark, [1.0], [2.0], "jpq")
    assert near(none, one, 50, 10).count() == 0
    assert near(one.toDF("i", "x", "y"), none.toDF("j", "p", "q"), 50, 10).count() == 0
