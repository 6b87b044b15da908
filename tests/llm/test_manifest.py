"""The Merkle manifest against a recursion in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from colectivo.llm import manifest

SCHEMA = "doc_id long, source string, text string, hash string, pos string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(nodes):
    """The root of a list and each member's siblings, level by level, as (left, right)."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            ways[i].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
            at[i] = p // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], ways


def expected(rows):
    by_source = {}
    for i, s, t in rows:
        by_source.setdefault(s, []).append((i is not None, i or 0, h(enc(i), enc(s), enc(t))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    roots = {s: grow([x[2] for x in sorted(by_source[s])]) for s in order}
    root, top = grow([roots[s][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for (known, i, leaf), way in zip(sorted(by_source[s]), roots[s][1]):
            out.append((i if known else None, leaf, roots[s][0], root, tuple(way + top[n])))
    return sorted(out, key=str)


def made(df, levels):
    out = manifest.manifest(df, ["doc_id", "source", "text"], levels=levels)
    assert out.columns == ["id", "leaf", "subroot", "root", "proof"]
    rows = out.withColumn("folded", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in rows)
    return sorted(((r.id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_equals_recursion(spark, levels):
    rng = random.Random(levels)
    sizes = {None: 4, "": 1, "a": 3, "b": 9, "Z": 10, "é": 2, "hot": 100}
    rows = [(i, s, rng.choice([None, "", "x\ny", "é😀" * 9, f"t{i}"])) for s, n in sizes.items() for i in rng.sample(range(1000), n)]
    rows += rows[:3] + [(None, "b", "t"), (None, "b", None), (7, "a", "q" * 100_000)]  # repeated rows, null ids, a long text
    assert made(frame(spark, rows), levels) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28])
def test_one_source(spark, n):
    rows = [(i, "s", str(i)) for i in range(n)]
    assert made(frame(spark, rows), 2) == expected(rows)


def test_empty_and_tampered(spark):
    assert made(frame(spark, []), 2) == []
    rows = [(i, "ab"[i % 2], f"line\n{i}") for i in range(40)]
    bare = manifest.leaf_of(F.col("doc_id"), F.col("source"), F.regexp_replace("text", "\n", ""))
    out = manifest.manifest(frame(spark, rows), ["doc_id", "source", "text"], carry={"leaf": bare, "hash": F.col("doc_id") * 2}, levels=1)
    assert out.columns == ["id", "leaf", "subroot", "root", "proof", "leaf", "hash"]
    rows = out.toDF("id", "leaf", "subroot", "root", "proof", "sent", "twice").withColumn("folded", manifest.folded(F.col("sent"), F.col("proof"))).collect()
    assert len(rows) == 40 and all(r.folded != r.root and r.sent != r.leaf and r.twice == 2 * r.id for r in rows)
