"""Loops that settle much in a round: equal to one choice at a time, in few rounds."""

import random

from colectivo.plans import lifecycle


def counted(monkeypatch, module):
    cuts, cut = [], module.snapshot
    monkeypatch.setattr(module, "snapshot", lambda df: cuts.append(1) or cut(df))
    return cuts


def test_line_takes_all_that_it_wins_at_once(spark, monkeypatch):
    rng = random.Random(8)
    ages = [(k, rng.randint(0, 12)) for k in range(30)] + [(k, 0) for k in range(100, 140)]
    pairs = [(a, b, rng.choice([0.7, 0.8, 0.9, 1.0])) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2]
    pairs += [(a, b, 1.0) for a in range(100, 140) for b in range(a + 1, 140)]
    born, want = dict(ages), {}
    for _, a, b in sorted((-r, a, b) for a, b, r in pairs):
        if a not in want and b not in want:
            old, young = sorted((a, b), key=lambda k: (born[k], k))
            want[young] = old
    cuts = counted(monkeypatch, lifecycle)
    rows = spark.createDataFrame(pairs + [(b, a, r) for a, b, r in pairs], "a bigint, b bigint, ratio double")
    out = lifecycle._merge_overlapping(rows, spark.createDataFrame(ages, "line_id bigint, created_at bigint")).collect()
    assert {r.line_id: r.target for r in out} == want and len(out) == len(want)
    assert len(cuts) <= 25  # one of 40 copies a round would be three cuts for each
