"""Exact search for the rows of greatest inner product, block by block of the rows' order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import snapshot
from .common import give_back

#: Rows of a block, most rows of a shard (blocks that lie together in one task), queries of a group, groups of a lane.
BLOCK, SHARD, GROUP, LANE = 256, 32768, 1024, 32
#: Rows that the planes of the rows' order are drawn from, and the number of planes. Results don't depend on them.
SAMPLE, PLANES = 64, 24
#: Below every score and above every id.
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vec: Column, scale: int = 64) -> Column:
    """Integer terms of a vector: the floor of ``scale`` times each component, in the range of a long."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold every inner product of rows of a and b."""
    return float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1) < 2.0**53


def _dot(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """``a @ b.T`` of integers; without ``exact`` by whole numbers of any size, and what a long can't hold stays at its end."""
    if exact:
        return (a.astype(float, copy=False) @ b.astype(float, copy=False).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LOW + 1, HIGH).astype(np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What no row of a block can exceed: for each query the sum of its terms' greatest shares within the block."""
    terms, most = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), np.hstack([high, low])
    return _dot(terms, most, _exact(terms, most))


def search(q: np.ndarray, own: np.ndarray, least: np.ndarray, least_id: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best rows of ``blocks (ids, terms)`` for each query: scores, ids and the number of scores taken.

    Each query takes the blocks by falling bound, scores a block's rows with
    their forward index, and stops when the next bound lies below its k-th
    score. ``least`` and ``least_id`` are the k-th score and id that it brings
    along from other blocks. A block whose bound equals the k-th score counts
    only if it has a smaller id. The row ``own`` of a query is no candidate.
    """
    low, high = (np.array([f(x, axis=0) for _, x in blocks]) for f in (np.min, np.max))
    bound, exact = bounds(q, low, high), _exact(q, np.vstack([low, high]))
    forward = [x.astype(float) if exact else x for _, x in blocks]
    terms = q.astype(float) if exact else q
    first = np.array([ids.min() for ids, _ in blocks])
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    top = np.full((len(q), k), LOW)
    top_id = np.full((len(q), k), HIGH)
    kth, kth_id, active, taken = least.copy(), least_id.copy(), np.arange(len(q)), 0
    for turn in range(len(blocks)):
        active = active[bound[active, turn] >= kth[active]]
        if not len(active):
            break
        at = order[active, turn]
        open_ = (bound[active, turn] > kth[active]) | ((bound[active, turn] == kth[active]) & (first[at] < kth_id[active]))
        asking, at = active[open_], at[open_]
        for b in np.unique(at):
            rows, ids = asking[at == b], blocks[b][0]
            score = _dot(terms[rows], forward[b], exact)
            taken += score.size
            score[ids[None, :] == own[rows][:, None]] = LOW
            better = (score > kth[rows][:, None]) | ((score == kth[rows][:, None]) & (ids[None, :] < kth_id[rows][:, None]))
            better &= score > LOW
            some = better.any(1)
            rows, score, better = rows[some], score[some], better[some]
            if not len(rows):
                continue
            score = np.hstack([top[rows], np.where(better, score, LOW)])
            both = np.hstack([top_id[rows], np.where(better, ids[None, :], HIGH)])
            best = np.lexsort((both, -score.clip(LOW + 1)), axis=1)[:, :k]
            top[rows], top_id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(both, best, 1)
            up = (top[rows, -1] > kth[rows]) | ((top[rows, -1] == kth[rows]) & (top_id[rows, -1] < kth_id[rows]))
            kth[rows[up]], kth_id[rows[up]] = top[rows[up], -1], top_id[rows[up], -1]
    return top, top_id, taken


def _found(query_ids: np.ndarray, top: np.ndarray, top_id: np.ndarray) -> pd.DataFrame:
    real = top > LOW
    return pd.DataFrame({"query_id": np.repeat(query_ids, real.sum(1)), "vec_id": top_id[real], "score": top[real]})


def _terms(flat, dims: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.int64).reshape(-1, dims)


def _pack(dims: int):
    """Cut sorted partitions into blocks of consecutive rows: ids, terms, and the least and greatest value of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            ids, x, asks = (np.concatenate(c) for c in zip(*held, strict=True))
            made = {"part": part, "start": done * BLOCK, "low": x.min(0), "high": x.max(0), "ids": ids, "terms": x.ravel(), "asks": asks}
            return pa.RecordBatch.from_pylist([made], schema=_BLOCK)

        for batch in batches:
            if not batch.num_rows:
                continue
            flat, size = np.asarray(batch.column(1).flatten()), np.diff(batch.column(1).offsets.to_numpy())
            x = np.zeros((batch.num_rows, dims), dtype=np.int64)
            x[np.arange(dims)[None, :] < size[:, None]] = flat
            ids, asks = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            while len(ids):
                room = BLOCK - sum(len(h[0]) for h in held)
                held.append((ids[:room], x[:room], asks[:room]))
                ids, x, asks = ids[room:], x[room:], asks[room:]
                if sum(len(h[0]) for h in held) == BLOCK:
                    yield block()
                    held, done = [], done + 1
        if held:
            yield block()
        give_back()

    return run


_BLOCK = pa.schema([("part", pa.int64()), ("start", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("low", "high", "ids", "terms")), ("asks", pa.list_(pa.bool_()))])


def _ordered(kept: DataFrame, dims: int, seed_rows: list[np.ndarray]):
    """Each row with the planes it lies above as one number, so that rows in order of it lie close together."""
    half = min(len(seed_rows) // 2, PLANES)
    a, b = (np.array(seed_rows[i * half : (i + 1) * half], dtype=float).reshape(half, dims) for i in (0, 1))
    normal, level = a - b, ((a - b) * (a + b)).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            x = np.zeros((batch.num_rows, dims))
            x[np.arange(dims)[None, :] < size[:, None]] = np.asarray(batch.column(1).flatten())
            key = ((x @ normal.T > level) @ (1 << np.arange(half)[::-1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["id", "v", "q", "key"])

    return kept.mapInArrow(run, "id long, v array<long>, q boolean, key long")


def top_k(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of greatest integer inner product with each row for which ``queries`` holds.

    Components become ``floor(scale * x)``; the score is their exact inner
    product. Candidates are all rows but the query's own; greatest first, ties
    to the smaller id, all candidates if there are fewer. A vector that is
    null or holds a null or non-finite component takes no part, nor does a row
    with a null id. Terms that a shorter or empty vector lacks count as 0, so
    a zero vector scores 0. Of rows with one id the one with the least vector
    counts. What a long can't hold stays at its end. ``queries`` may name any
    column of ``rows``; other columns play no part. An empty table gives no rows.

    Rows are sorted by the planes that they lie above and cut into blocks of
    256, neighbours in that order; a shard is some 2 048 to 32 768 consecutive rows. First each
    query searches its own shard, which brings a k-th score. Then groups of
    queries meet the shards' term maxima, and a query goes on only to shards
    whose bound reaches that score; there it takes blocks by falling bound, as
    ``search`` says. Groups and shards are bounded, copies of rows are just
    more rows of the order, and a shard that very many queries ask is copied
    to one task for each 32 groups of them. How much the bounds save depends
    on the data: nothing on vectors that spread evenly over the sphere.
    """
    spark = rows.sparkSession
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"), fine.alias("fine"))
    kept = kept.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.col("fine")).select("id", quantised(F.col("v"), scale).alias("v"), "q")
    kept = snapshot(kept.groupBy("id").agg(F.min(F.struct("v", "q")).alias("row")).select("id", "row.v", "row.q"))
    shape = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("asked"), F.max(F.size("v")).alias("dims")).first()
    if not shape["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(shape["dims"], 1)
    shard_rows = min(SHARD, max(2048, -(-shape["n"] // (64 * BLOCK)) * BLOCK))
    sample = [np.pad(np.array(r["v"], dtype=np.int64), (0, dims - len(r["v"]))) for r in kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    near = _ordered(kept, dims, sample).repartitionByRange(-(-shape["n"] // shard_rows), "key", "id").sortWithinPartitions("key", "id")
    kind = "part long, start long, low array<long>, high array<long>, ids array<long>, terms array<long>, asks array<boolean>"
    blocks = snapshot(near.select("id", "v", "q").mapInArrow(_pack(dims), kind))
    held = blocks.groupBy("part").agg(F.sum(F.size("ids")).alias("rows"))  # one row for each sorted range
    before = held.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    blocks = snapshot(blocks.join(before, "part").withColumn("shard", F.floor((F.col("before") + F.col("start")) / shard_rows)).drop("part", "start", "before"))

    def terms(flat) -> np.ndarray:
        return np.asarray(flat, dtype=np.int64).reshape(-1, dims)

    def own_shard(held: pd.DataFrame) -> pd.DataFrame:
        index = [(np.asarray(i), terms(x)) for i, x in zip(held["ids"], held["terms"], strict=True)]
        asks = [np.asarray(a, dtype=bool) for a in held["asks"]]
        ids = np.concatenate([i[a] for (i, _), a in zip(index, asks, strict=True)])
        q = np.concatenate([x[a] for (_, x), a in zip(index, asks, strict=True)])
        top, top_id = np.full((len(ids), k), LOW), np.full((len(ids), k), HIGH)
        for a in range(0, len(ids), GROUP):
            part = slice(a, a + GROUP)
            start = np.full(len(ids[part]), LOW), np.full(len(ids[part]), HIGH)
            top[part], top_id[part], _ = search(q[part], ids[part], *start, index, k)
        real = top > LOW
        return pd.DataFrame({
            "query": ids, "terms": list(q), "shard": held["shard"].iloc[0], "kth": top[:, -1], "kth_id": top_id[:, -1],
            "ids": [i[r] for i, r in zip(top_id, real, strict=True)], "scores": [s[r] for s, r in zip(top, real, strict=True)],
        })

    def outline(held: pd.DataFrame) -> pd.DataFrame:
        low, high = np.vstack(held["low"].to_numpy()).min(0), np.vstack(held["high"].to_numpy()).max(0)
        return pd.DataFrame({"shard": [held["shard"].iloc[0]], "low": [low], "high": [high], "least": [held["least"].min()], "most": [held["most"].max()], "n": [held["n"].sum()]})

    found = snapshot(blocks.where(F.exists("asks", lambda a: a)).select("shard").distinct().join(blocks, "shard").groupBy("shard").applyInPandas(
        own_shard, "query long, terms array<long>, shard long, kth long, kth_id long, ids array<long>, scores array<long>"
    ))
    lines = snapshot(blocks.select("shard", "low", "high", F.array_min("ids").alias("least"), F.array_max("ids").alias("most"), F.size("ids").alias("n")).groupBy("shard").applyInPandas(
        outline, "shard long, low array<long>, high array<long>, least long, most long, n long"
    ))
    groups, piles = -(-shape["asked"] // GROUP), -(-lines.count() // 1024)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bucket = lambda c, n: F.pmod(F.xxhash64(F.lit("bucket"), c), F.lit(n)).cast("int")
    asked = found.select(bucket("query", groups).alias("group"), spread(piles).alias("pile"), "query", "terms", "shard", "kth", "kth_id")
    offered = lines.select(spread(groups).alias("group"), bucket("shard", piles).alias("pile"), "shard", "low", "high", "least", "most", "n")

    def choose(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["shard", "lane", "queries", "terms", "kth", "kth_id"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        q, kth, kth_id, ids = np.vstack(left["terms"].to_numpy()), left["kth"].to_numpy(), left["kth_id"].to_numpy(), left["query"].to_numpy()
        low, high = np.vstack(right["low"].to_numpy()), np.vstack(right["high"].to_numpy())
        most = bounds(q, low, high)
        alike = np.flatnonzero((low == high).all(1) & (right["n"].to_numpy() > k))
        if len(alike):  # shards of copies: their score is known, so k of them are a k-th score; of equal ones the shard of smaller ids
            alike = alike[np.argsort(right["most"].to_numpy()[alike], kind="stable")]
            pick = alike[most[:, alike].argmax(1)]
            score, beyond = most[np.arange(len(q)), pick], right["most"].to_numpy()[pick] + 1
            up = (score > kth) | ((score == kth) & (beyond < kth_id))
            kth, kth_id = np.where(up, score, kth), np.where(up, beyond, kth_id)
        open_ = (most > kth[:, None]) | ((most == kth[:, None]) & (right["least"].to_numpy()[None, :] < kth_id[:, None]))
        open_ &= left["shard"].to_numpy()[:, None] != right["shard"].to_numpy()[None, :]
        out = [(s, key[0] // LANE, ids[o], q[o].ravel(), kth[o], kth_id[o]) for s, o in zip(right["shard"], open_.T, strict=True) if o.any()]
        return pd.DataFrame(out, columns=names)

    open_ = snapshot(asked.groupBy("group", "pile").cogroup(offered.groupBy("group", "pile")).applyInPandas(
        choose, "shard long, lane int, queries array<long>, terms array<long>, kth array<long>, kth_id array<long>"
    ))

    def other_shards(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = [(np.asarray(i), terms(x)) for i, x in zip(right["ids"], right["terms"], strict=True)]
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        for ids, q, kth, kth_id in zip(left["queries"], left["terms"], left["kth"], left["kth_id"], strict=True):
            top, top_id, _ = search(terms(q), np.asarray(ids), np.asarray(kth), np.asarray(kth_id), index, k)
            real = top > LOW
            out.append(pd.DataFrame({"query_id": np.repeat(ids, real.sum(1)), "vec_id": top_id[real], "score": top[real]}))
        return pd.concat(out, ignore_index=True)

    lanes = open_.select(F.col("shard").alias("in"), F.col("lane").alias("to")).distinct()
    met = lanes.join(blocks.select("shard", "ids", "terms"), F.col("in") == F.col("shard")).drop("shard")
    more = open_.groupBy("shard", "lane").cogroup(met.groupBy("in", "to")).applyInPandas(other_shards, "query_id long, vec_id long, score long")
    mine = found.select(F.col("query").alias("query_id"), F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = mine.toDF("query_id", "vec_id", "score").unionByName(more).withColumn("rank", rank)
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
