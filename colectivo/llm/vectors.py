"""Nearest neighbours and near-duplicates among embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import snapshot
from .common import components

#: Search: rows that the lists are fitted on at most, rows and queries of a block, share of the lists that a query
#: probes, columns of a block of the rotated vectors, confidence of the test (larger abandons less).
SAMPLE, LIST_ROWS, QUERY_ROWS, PROBE, COLUMNS, EPSILON = 8192, 4096, 1024, 0.8, 16, 2.1
#: Near-duplicates: passes, neighbours that each vector is compared with in a pass, rows of a block.
PASSES, WINDOW, BLOCK = 16, 64, 512
#: Rows of a label's block when all its pairs are compared, from and to; rows of a label's sample; share of links at the
#: least cosine that the passes may miss.
PAIR_ROWS, PLAN_ROWS, MISS = (512, 4096), 4096, 0.001
#: Bytes of vectors in a block of a large label that is compared whole, and its rows that are multiplied at once.
WHOLE_BYTES, TILE = 16 << 20, 4096


def usable(rows: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and holds no null or non-finite component, as doubles."""
    ok = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    return rows.where(F.coalesce(ok, F.lit(False))).withColumn(vec, F.col(vec).cast("array<double>"))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.vstack(column.to_numpy())
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# -- approximate nearest neighbours ---------------------------------------------------------------


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means over the sample."""
    centres = sample[:: max(1, len(sample) // n)][:n].copy()
    for _ in range(10):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(1))
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def scan(query: np.ndarray, blocks: list[np.ndarray], dims: int, k: int, own: int) -> np.ndarray:
    """Candidates of one block that the query's distance tests did not abandon (their places).

    ``blocks`` are the rotated unit vectors, some columns at a time, one row per
    dimension. The first columns' distances pick 4k candidates, whose whole
    distances set the threshold. Then, block after block, a candidate is
    abandoned when its partial distance, scaled to all dimensions, exceeds the
    threshold by more than chance allows for a random rotation.
    """
    n = blocks[0].shape[1]
    q = np.split(query, np.cumsum([b.shape[0] for b in blocks])[:-1])
    part = ((blocks[0] - q[0][:, None]) ** 2).sum(0)
    if own >= 0:
        part[own] = np.inf
    alive = np.arange(n)
    if n > 4 * k:
        probe = np.argpartition(part, 4 * k)[: 4 * k]
        full = part[probe].copy()
        for b, x in zip(blocks[1:], q[1:], strict=True):
            full += ((b[:, probe] - x[:, None]) ** 2).sum(0)
        limit = np.partition(full, k - 1)[k - 1]
        seen = 0
        for i, b in enumerate(blocks):
            if i:
                part = part + ((b[:, alive] - q[i][:, None]) ** 2).sum(0)
            seen += b.shape[0]
            if seen < dims:
                kept = part * (dims / seen) <= limit * (1 + EPSILON / np.sqrt(seen)) ** 2
            else:
                kept = part <= limit * (1 + 1e-9)
            alive, part = alive[kept], part[kept]
    return alive[alive != own]


def nearest(rows: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows by cosine of each row for which ``queries`` holds.

    Candidates are all rows but the query's own; nearest first, ties to the
    smaller id, all candidates if there are fewer. Vectors that are null,
    empty or zero or hold a null or non-finite component take no part, nor do
    rows with a null id, nor vectors of another length than the most frequent
    one (the smaller of equally frequent ones). Of rows with one id the one
    with the least vector counts. Scores are exact, in double precision.

    The lists come from k-means over a sample of at most 8 192 rows; every row
    is in the list of its nearest centre. Queries probe 80 % of the lists, the
    nearest first. A list is cut into blocks of about 4 096 rows by a hash of
    the id, the queries that probe it into blocks of about 1 024, so a hot
    list is spread over many tasks. Within a block the candidates are scanned
    as ``scan`` says, and what is left is scored on the original vectors.
    """
    spark = rows.sparkSession
    kept = usable(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col(id_col).isNotNull()), "v")
    kept = kept.groupBy("id").agg(F.min("v").alias("v"))
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    dims = sizes["d"]
    kept = snapshot(kept.where(F.size("v") == dims))
    total = sizes["count"]
    unit = F.pmod(F.xxhash64(F.lit("lists"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = kept.where(unit <= min(1.0, 0.8 * SAMPLE / total)).orderBy("id").limit(SAMPLE).collect() or kept.limit(1).collect()
    n_lists = max(1, min(4096, round(total**0.5 / 4), len(sample)))
    centres = _centres(_unit(np.array([r["v"] for r in sample])), n_lists)
    n_lists = len(centres)
    probes = max(1, round(PROBE * n_lists))
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = _unit(_matrix(batch.column(1))) @ centres.T
                asked = np.argsort(-like, axis=1, kind="stable")[:, :probes].astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum(np.asarray(batch.column(2)) * probes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(asked[np.asarray(batch.column(2))].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like.argmax(1).astype(np.int32)), lists], names=["id", "v", "list", "asks"])

    is_query = kept.withColumnRenamed("id", id_col).withColumn("q", F.coalesce(queries, F.lit(False))).select(F.col(id_col).alias("id"), "v", "q")
    placed = snapshot(is_query.mapInArrow(place, "id long, v array<double>, list int, asks array<int>"))
    asks = placed.where(F.size("asks") > 0).select("id", "v", F.explode("asks").alias("list"))
    rows_of = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("cuts"))
    asks_of = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("qcuts"))
    shape = snapshot(rows_of.join(asks_of, "list"))
    salt = lambda n: F.pmod(F.xxhash64(F.lit("block"), "id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = placed.select("id", "v", "list").join(shape, "list").select("list", salt("cuts").alias("cut"), spread("qcuts").alias("qcut"), "id", "v")
    asked = asks.join(shape, "list").select("list", spread("cuts").alias("cut"), salt("qcuts").alias("qcut"), "id", "v")

    def block(both: pd.DataFrame) -> pd.DataFrame:
        left, right = both[~both["asks"]], both[both["asks"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        left = left.sort_values("id")
        ids, x = left["id"].to_numpy(), _matrix(left["v"])
        turned = (_unit(x) @ rotation).T
        blocks = [np.ascontiguousarray(turned[a : a + COLUMNS]) for a in range(0, dims, COLUMNS)]
        scale = np.abs(x).max(axis=1)
        x = x / scale[:, None]
        norm = np.sqrt((x * x).sum(1))
        asking = _matrix(right["v"])
        turned_q = _unit(asking) @ rotation
        found = []
        for q, qid, t in zip(asking / np.abs(asking).max(axis=1, keepdims=True), right["id"].to_numpy(), turned_q, strict=True):
            at = np.searchsorted(ids, qid)
            own = int(at) if at < len(ids) and ids[at] == qid else -1
            left_over = scan(t, blocks, dims, k, own)
            score = (x[left_over] @ q) / (norm[left_over] * np.sqrt((q * q).sum()))
            best = np.lexsort((ids[left_over], -score))[:k]
            found.append(pd.DataFrame({"query_id": qid, "vec_id": ids[left_over[best]], "score": score[best]}))
        return pd.concat(found, ignore_index=True)

    keys = ["list", "cut", "qcut"]
    both = base.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    near = both.groupBy(*keys).applyInPandas(block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# -- near-duplicates ------------------------------------------------------------------------------


def _neighbours(least: float):
    """Links between rows at most 64 places apart, in partitions sorted by pass, label and key.

    Of the links of a batch a forest goes out that joins the same rows; ``near_vectors`` counts links later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(i)) for i in range(3)]
            x, size = batch.column(3).flatten().to_numpy(), np.diff(batch.column(3).offsets.to_numpy())
            rows = np.split(x, np.cumsum(size)[:-1])
            width = max(int(size.max()), held[3].shape[1] if held else 0)
            pad = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                pad[i, : len(r)] = r
            now += [pad, size]
            fresh = 0
            if held:
                old = np.zeros((len(held[3]), width))
                old[:, : held[3].shape[1]] = held[3]
                fresh = len(old)
                now = [np.concatenate([h, n]) for h, n in zip([*held[:3], old, held[4]], now, strict=True)]
            pas, label, ids, vec, dim = now
            a, b = [], []
            for d in range(1, min(WINDOW, len(ids) - 1) + 1):
                lo = max(0, fresh - d)  # pairs within the held rows were seen before
                dot = np.einsum("ij,ij->i", vec[lo:-d], vec[lo + d :])
                hit = np.flatnonzero((dot >= least) & (pas[lo:-d] == pas[lo + d :]) & (label[lo:-d] == label[lo + d :]) & (dim[lo:-d] == dim[lo + d :]))
                a.append(lo + hit)
                b.append(lo + hit + d)
            if a:
                on, first = _forest(np.concatenate(a), np.concatenate(b), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[first])], names=["a", "b"])
            held = tuple(v[-WINDOW:] for v in (pas, label, ids, vec, dim))

    return run


ENDS = ["pass", "label", "id", "x"]


def _swept(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within a sorted partition; then its first and last ``WINDOW`` rows, each with the border it lies at."""
        head, tail, me = [], [], TaskContext.get().partitionId()

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal head, tail
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                head = pa.concat_tables([head, rows.slice(0, WINDOW - len(head))] if len(head) else [rows.slice(0, WINDOW)])
                tail = pa.concat_tables([tail, rows]) if len(tail) else rows
                tail = tail.slice(max(0, len(tail) - WINDOW)).take(pa.array(range(min(len(tail), WINDOW))))
                yield batch

        def out(n: int, known: dict) -> pa.RecordBatch:
            kinds = {"a": pa.int64(), "b": pa.int64(), "border": pa.int32(), "at": pa.int32(), "pass": pa.int32(), "label": pa.int64(), "id": pa.int64(), "x": pa.list_(pa.float64())}
            return pa.RecordBatch.from_arrays([known[k].cast(t) if k in known else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

        for batch in _neighbours(least)(seen()):
            yield out(batch.num_rows, {"a": batch.column(0), "b": batch.column(1)})
        for border, rows, start in ((me, head, WINDOW), (me + 1, tail, 0)):
            if n := len(rows):
                rows = rows.combine_chunks().to_batches()[0]
                at = {"border": pa.array(np.full(n, border, np.int32)), "at": pa.array(np.arange(start, start + n, dtype=np.int32))}
                yield out(n, at | {name: rows.column(i) for i, name in enumerate(ENDS)})

    return run


def _across(least: float):
    def run(border: pa.Table) -> pa.Table:
        """Links across one border: the last rows before it are at 0 and up, the first after it at ``WINDOW`` and up."""
        rows = border.sort_by("at").select(ENDS).combine_chunks().to_batches()
        found = list(_neighbours(least)(iter(rows)))
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``n`` rows as one link of each row to the first of those it is joined with."""
    least_of = np.arange(n)
    while True:
        new = least_of.copy()
        np.minimum.at(new, a, least_of[b])
        np.minimum.at(new, b, least_of[a])
        new = new[new]
        if (new == least_of).all():
            break
        least_of = new
    on = np.flatnonzero(least_of != np.arange(n))
    return on, least_of[on]


def _signs(x: np.ndarray, seed: int, p: int) -> np.ndarray:
    planes = np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], 64))
    return np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _all_pairs(least: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """A forest of the links between two blocks of a label, or within one."""
        x, ids, one = _unit(_matrix(block["v"])), block["id"].to_numpy(), (block["s"] == block["i"]).to_numpy()
        left = np.flatnonzero(one)
        right = left if block["i"].iloc[0] == block["j"].iloc[0] else np.flatnonzero(~one)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(0, len(left), BLOCK):
            for m in range(0, len(right), TILE):
                r, c = np.nonzero(x[left[k : k + BLOCK]] @ x[right[m : m + TILE]].T >= least)
                if len(r):
                    rows, at = np.unique(np.concatenate([left[k + r], right[m + c]]), return_inverse=True)
                    on, first = _forest(at[: len(r)], at[len(r) :], len(rows))
                    a.append(rows[on])
                    b.append(rows[first])
        on, first = _forest(np.concatenate(a), np.concatenate(b), len(ids))
        return pd.DataFrame({"a": ids[on], "b": ids[first]})

    return run


def _planned(least: float, seed: int, fewest: int):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        """Mean direction of a label and the passes that miss at most ``MISS`` of the links at the least cosine.

        Partners at that cosine are made for rows of the sample. The chance to
        be within a window falls as a power of the window's share of the label;
        the power is taken from two windows that the sample resolves.
        """
        x, rng, wide = _unit(_matrix(sample["v"])), np.random.default_rng(seed), (8, 64)
        mean = x.mean(axis=0)
        own = x[rng.permutation(len(x))[:512]]
        off = rng.standard_normal(own.shape)
        off = _unit(off - (off * own).sum(axis=1, keepdims=True) * own)
        mate = least * own + np.sqrt(1 - least * least) * off
        hits = np.zeros((2, len(own)))
        for p in range(128):
            keys = np.sort(_signs(x - mean, seed, p))
            gap = np.abs(np.searchsorted(keys, _signs(own - mean, seed, p)) - np.searchsorted(keys, _signs(mate - mean, seed, p)))
            hits += [gap < w for w in wide]
        near, far = hits.mean(axis=1) / 128
        passes, n = 0, sample["n"].iloc[0]
        if near > 0:
            share = (WINDOW / n) / (wide[1] / len(x))
            chance = np.minimum(1, np.maximum(hits[1], 0.5) / 128 * share ** max(0.0, np.log(far / near) / np.log(wide[1] / wide[0])))
            passes = next((p for p in range(fewest, 4096) if ((1 - chance) ** p).mean() <= MISS), 0)
        return pd.DataFrame({"label": sample["label"].iloc[:1], "d": sample["d"].iloc[:1], "mean": [mean], "passes": [passes]})

    return run


def _plan(sized: DataFrame, sizes: DataFrame, copies: int, least: float, seed: int, passes: int) -> DataFrame:
    """``sizes`` with the mean direction and the passes of labels of more than ``copies`` blocks; no passes where all pairs cost less."""
    kind = sized.schema["label"].dataType.simpleString()
    large = sized.join(sizes.where(F.col("cuts") > copies), ["label", "d"])
    sample = large.where(F.pmod(F.xxhash64("id", F.lit("plan")), F.ceil(F.col("n") / PLAN_ROWS)) == 0).select("label", "d", "n", "v")
    plan = sample.groupBy("label", "d").applyInPandas(_planned(least, seed, passes), f"label {kind}, d int, mean array<double>, passes int")
    return snapshot(sizes.join(plan, ["label", "d"], "left").withColumn("passes", F.when((F.col("passes") > 0) & (F.col("passes") < F.col("cuts")), F.col("passes"))))


def near_vectors(
    rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", passes: int = PASSES, seed: int = 5, copies: int | None = None
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row of ``rows``.

    Two vectors link if their labels are equal and not null, their lengths are
    equal and their cosine, in double precision, is at least ``least``.
    ``n_links`` counts the other vectors linked directly; the component is the
    least id reachable, and that row is kept. Null, empty or zero vectors and
    those with null or non-finite components link with nothing; a null id does
    not either, has no component and is kept. Of rows with one id, each counts
    as a vector, and they share a component if any of them links.

    1. Equal vectors of a label become one class with a weight.
    2. A label of n classes is cut into blocks by hash, of n / 8 rows, at least
       512 and at most 16 MB, and all pairs of blocks are compared, whatever
       the label's size, so no link is missed. The cost grows with the square
       of a label.
       A caller that prefers speed may give ``copies``: labels of more blocks
       (of at most 4 096 rows) are then planned on a sample for sorted passes,
       at least ``passes``, as many as miss at most 0.1 % of the links
       at the least cosine.
       In each pass its classes are sorted by the 64 signs of random
       projections, taken from the label's mean direction, and each is compared
       with the 64 before it, across partitions too. The passes are rows of one
       sort, so no group is brought together. If the passes would copy the rows
       more often than the blocks, the label is compared whole as well.
    3. Links join into components. Beyond the windows, links are counted
       exactly within components: vectors within half the link angle of the
       component's mean direction all link with each other, which needs no
       comparison; the others are compared with all members in blocks of 512 x
       512 that return counts, not pairs.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    good = usable(given.where("id IS NOT NULL AND label IS NOT NULL"), "v").withColumns({"h": F.xxhash64("label", "v"), "g": F.xxhash64(F.lit("v"), "v", "label")})
    ids = snapshot(good.select("id", "h", "g"))
    classes = snapshot(good.groupBy("h", "g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("label").alias("label"), F.first("v").alias("v")))

    kind = classes.schema["label"].dataType.simpleString()
    sized = classes.select("id", "label", "v", F.size("v").alias("d"))
    low, high = PAIR_ROWS
    sizes = sized.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    most = f"{high}D" if copies is not None else f"greatest({high}D, {WHOLE_BYTES}D / (8 * d))"
    sizes = snapshot(sizes.withColumn("cuts", F.expr(f"cast(ceil(n / least({most}, greatest({low}D, n / 8))) as int)")))
    plan = sizes.withColumn("passes", F.lit(None).cast("int")) if copies is None else _plan(sized, sizes, copies, least, seed, passes)

    cut = sized.join(plan.where("passes IS NULL").select("label", "d", "cuts"), ["label", "d"]).withColumn("s", F.pmod(F.xxhash64("id", F.lit("cut")), "cuts").cast("int"))
    cut = cut.select("label", "d", "id", "v", "s", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("t"))
    cut = cut.select("label", "d", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", "id", "v")
    pairs = cut.groupBy("label", "d", "i", "j").applyInPandas(_all_pairs(least), "a long, b long")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                size = np.diff(part.column(2).offsets.to_numpy())
                for dim in np.unique(size):
                    some = part.take(pa.array(np.flatnonzero(size == dim)))
                    x, n_passes = _unit(_matrix(some.column(2))), np.asarray(some.column(4))
                    from_mean = x - _matrix(some.column(3))
                    for p in range(n_passes.max()):
                        on = np.flatnonzero(n_passes > p)
                        key = (_signs(from_mean[on], seed, p) ^ np.uint64(1 << 63)).view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1, dtype=np.int32) * dim), pa.array(x[on].ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(on), p, np.int32)), some.column(1).take(pa.array(on)), pa.array(key), some.column(0).take(pa.array(on)), lists],
                            names=["pass", "label", "key", "id", "x"],
                        )

    order = ["pass", "label", "key", "id"]
    many = sized.join(plan.where("passes IS NOT NULL"), ["label", "d"])
    if copies is not None and not many.isEmpty():
        runs = many.select("id", "label", "v", "mean", "passes").mapInArrow(keyed, f"pass int, label {kind}, key long, id long, x array<double>")
        runs = runs.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", F.xxhash64("label").alias("label"), "id", "x")
        swept = snapshot(runs.mapInArrow(_swept(least), "a long, b long, border int, at int, pass int, label long, id long, x array<double>"))
        ends = swept.where("border IS NOT NULL").groupBy("border").applyInArrow(_across(least), "a long, b long")
        pairs = pairs.union(swept.where("border IS NULL").select("a", "b")).union(ends)
    links = snapshot(pairs.distinct())
    found = snapshot(components(links))

    member = snapshot(classes.join(found.withColumnRenamed("node", "id"), "id").select("id", "w", "label", "component", F.col("v"), F.size("v").alias("d")))
    n_of = member.select("component", "d", "w", F.posexplode("v").alias("i", "x"), F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))").alias("norm"))
    mean = n_of.groupBy("component", "d", "i").agg(F.sum(F.col("x") / F.col("norm")).alias("x"))
    mean = mean.groupBy("component", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    dot = "aggregate(zip_with(v, m, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    size = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    half = float(np.cos(np.arccos(least) / 2)) + 1e-9
    tight = F.expr(f"{dot} / ({size.format('v')} * {size.format('m')})") >= half
    member = snapshot(member.join(snapshot(mean), ["component", "d"]).select("id", "w", "label", "component", "d", "v", F.coalesce(tight, F.lit(False)).alias("tight")))
    group = ["component", "label", "d"]
    inside = member.where("tight").groupBy(*group).agg(F.sum("w").alias("all"))
    near = member.where("tight").join(inside, group).select("id", (F.col("all") - F.col("w")).alias("n"))
    loose = member.where("NOT tight")
    shape = snapshot(member.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"), F.ceil(F.count_if(~F.col("tight")) / BLOCK).cast("int").alias("lcuts")).where("lcuts > 0"))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = loose.join(shape, group).select(*group, salt("lcuts").alias("i"), spread("cuts").alias("j"), "id", "w", "v", "tight")
    b = member.join(shape, group).select(*group, spread("lcuts").alias("i"), salt("cuts").alias("j"), "id", "w", "v", "tight")

    def counted(both: pd.DataFrame) -> pd.DataFrame:
        left, right = both[both["left"]], both[~both["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        hit = _unit(_matrix(left["v"])) @ _unit(_matrix(right["v"])).T >= least
        hit &= left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None, :]
        back = right["tight"].to_numpy()
        return pd.DataFrame({
            "id": np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()[back]]),
            "n": np.concatenate([hit @ right["w"].to_numpy(), (left["w"].to_numpy() @ hit)[back]]),
        })

    keys = [*group, "i", "j"]
    far = a.withColumn("left", F.lit(True)).unionByName(b.withColumn("left", F.lit(False))).groupBy(*keys).applyInPandas(counted, "id long, n long")
    between = snapshot(near.unionByName(far).groupBy("id").agg(F.sum("n").alias("n")))

    named = classes.select("h", "g", F.col("id").alias("rep"), "w").join(between.withColumnRenamed("id", "rep"), "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    per_row = snapshot(ids.join(named, ["h", "g"]).select("id", "h", "g", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c")))
    shared = per_row.groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    several = shared.where("lo < hi")
    if not several.isEmpty():  # an id with several vectors joins their components
        extra = per_row.join(several.select("id"), "id").select(F.col("id").alias("a"), F.col("c").alias("b"))
        joined = components(per_row.select(F.col("id").alias("a"), F.col("c").alias("b")).union(extra))
        per_row = per_row.drop("c").join(snapshot(joined), F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component")
    every = usable(given, "v").select("id", "label", F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit("v"), "v", "label").alias("g")).where("id IS NOT NULL AND label IS NOT NULL")
    marked = every.select("id", "h", "g").join(per_row.dropDuplicates(["id", "h", "g"]), ["id", "h", "g"]).select("id", "n_links", "c")
    ok = F.col("id").isNotNull() & F.col("label").isNotNull()
    bad = F.coalesce(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    alone = given.where(~(ok & bad)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    return marked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept")
    )


SQL_NEAR = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_max(embedding) IS NOT NULL AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
e AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS comp FROM v UNION SELECT y, comp FROM r JOIN e ON node = x WHERE comp < y),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.comp, d.vec_id) AS component_id, coalesce(c.comp, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN n ON n.x = d.vec_id LEFT JOIN c ON c.node = d.vec_id
"""
