"""Exact inner-product search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colectivo.llm import topk

LIMIT = np.iinfo(np.int64).max


def terms(v):
    return [max(-LIMIT - 1, min(LIMIT, int(np.floor(np.float64(64) * np.float64(x))))) for x in v]


def brute(rows, asked, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, terms(v)), terms(v))
    out = {}
    for q in best:
        if asked(q):
            score = lambda i: max(-LIMIT, min(LIMIT, sum(a * b for a, b in zip(best[q], best[i]))))
            near = sorted(((-score(i), i) for i in best if i != q))[:k]
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(near)}
    return out


def run(spark, rows, asked, k, **shape):
    df = spark.createDataFrame([(i, v, i if i is not None else 0, 1) for i, v in rows], "vec_id long, embedding array<double>, score long, shard int")
    out = topk.top_k(df, asked, k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "GROUP", 16)
    monkeypatch.setattr(topk, "LANE", 2)


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_equals_brute_force(spark, small_blocks, monkeypatch, kind):
    monkeypatch.setattr(topk, "SHARD", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    if kind == "clusters":
        x = 3 * x[:10][rng.integers(0, 10, 400)] + 0.1 * x
    if kind == "copies":
        x[rng.random(400) < 0.4] = x[0]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(400), x)]
    assert run(spark, rows, F.expr("vec_id % 3 = 0"), 5) == brute(rows, lambda i: i % 3 == 0, 5)


def test_odd_vectors(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, [0.0, 0.0]), (8, [1.0]), (None, [9.0, 9.0])]
    rows += [(9, [5.0, 1.0]), (9, [4.0, 1.0]), (10, [-1e300, 1.0]), (11, [2.0**55, -3.0]), (12, [2.0**55 + 8, -3.0]), (13, [-0.001, 0.5])]
    got = run(spark, rows, F.expr("vec_id > 0"), 4)
    assert got == brute(rows, lambda i: True, 4)
    assert run(spark, rows[:1], F.lit(True), 4) == {}
    assert run(spark, [], F.lit(True), 4) == {}
    assert run(spark, rows, F.lit(None).cast("boolean"), 4) == {}
    assert run(spark, [(1, []), (2, [])], F.lit(True), 4) == {(1, 1): (2, 0), (2, 1): (1, 0)}


def test_blocks_are_left_out_when_their_bound_is_low():
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (40, 16))
    blocks = [(np.arange(64) + 64 * b, c + rng.integers(-3, 4, (64, 16))) for b, c in enumerate(centres)]
    q = centres[:10] + rng.integers(-3, 4, (10, 16))
    start = np.full(10, topk.LOW), np.full(10, topk.HIGH)
    top, ids, taken = topk.search(q, np.full(10, -1), *start, blocks, 5)
    score = q @ np.vstack([x for _, x in blocks]).T
    for row in range(10):
        want = sorted(((-s, i) for i, s in enumerate(score[row])))[:5]
        assert [(-s, i) for s, i in zip(top[row], ids[row])] == want
    assert taken < score.size / 4
    # A k-th score brought along leaves only what beats it; a tie counts with a smaller id only.
    again, again_ids, fewer = topk.search(q, np.full(10, -1), top[:, -1], ids[:, -1], blocks, 5)
    assert fewer <= taken and (again[:, :4] == top[:, :4]).all() and (again[:, 4] == topk.LOW).all()
