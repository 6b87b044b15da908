"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import snapshot
from .common import components, packed, text_chunks, unpacked

#: Words of a shingle and similarity in percent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Permutations (each gives a minimum and a maximum), values in a band, members compared at once, bytes of text at once.
PERMUTATIONS, BAND, BLOCK, CHUNK_BYTES = 64, 4, 256, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_RANDOM = np.random.default_rng(11).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, sorted by both.

    Words are runs of bytes other than ASCII white space, with A-Z in lower
    case; a text of fewer words than a shingle has one of all its words.
    """
    parts = texts.cast(pa.binary()).to_pylist()
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))[-len(raw) :] if starts[0] == 0 else None
    if place is None:
        raw, space, ends = raw[starts[0] :], space[starts[0] :], ends - starts[0]
        starts = starts - starts[0]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))
    value = (_LOWER[raw] + np.uint64(1)) * _POWERS[place & 4095] * (2 * (place >> 12) + 1).astype(np.uint64)
    value[space] = 0
    word = _mix(np.add.reduceat(value, starts))
    owner = np.searchsorted(ends, starts, side="right")
    n = np.bincount(owner, minlength=len(parts))
    first = np.cumsum(n) - n
    out, who = [], []
    if len(word) >= words:
        whole = np.flatnonzero(owner[: len(word) - words + 1] == owner[words - 1 :])
        h = np.zeros(len(whole), np.uint64)
        for k in range(words):
            h = _mix(h * _RANDOM[200] + word[whole + k])
        out.append(h)
        who.append(owner[whole])
    short = np.flatnonzero((n > 0) & (n < words))
    h = np.full(len(short), words, np.uint64)
    for k in range(words - 1):
        on = n[short] > k
        h[on] = _mix(h[on] * _RANDOM[201] + word[first[short[on]] + k])
    out.append(h)
    who.append(short)
    who, out = np.concatenate(who), np.concatenate(out)
    order = np.lexsort((out, who))
    who, out = who[order], out[order]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (out[1:] != out[:-1])])[: len(who)]
    return who[new], out[new]


def signatures(who: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with shingles, their number, a 128-bit hash of the set (n x 2), and the band keys (n x bands)."""
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([starts, [len(who)]]))
    if not len(starts):
        return starts, n, np.zeros((0, 2), np.int64), np.zeros((0, 2 * PERMUTATIONS // BAND), np.int64)
    whole = np.column_stack([np.add.reduceat(_mix(hashes * _RANDOM[k]), starts) for k in (210, 211)])
    values = []
    for k in range(PERMUTATIONS):
        v = hashes * _RANDOM[k]
        values += [np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)]
    bands = []
    for b in range(0, len(values), BAND):
        key = np.full(len(starts), b + 1, np.uint64)
        for v in values[b : b + BAND]:
            key = _mix(key * _RANDOM[220] + v)
        bands.append(key)
    return who[starts], n, whole.view(np.int64), np.column_stack(bands).view(np.int64)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """``id, n, c, d, bands`` for ``docs (id, text)``: shingles, set hash and band keys; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            found, n, whole, bands = signatures(*shingles(batch.column(1).fill_null(""), words))
            size, both = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
            size[found], both[found] = n, whole
            cuts = np.concatenate([[0], np.cumsum((size > 0) * bands.shape[1])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], names=["id", "n", "c", "d", "bands"]
            )

    return docs.mapInArrow(run, "id long, n long, c long, d long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``id, s``: the sorted hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            who, h = shingles(batch.column(1).fill_null(""), words)
            cuts = np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.view(np.int64)))], names=["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One link for each two components of a block that have one: ``a, b``.

    Rows with ``stray`` are compared with the others. Common shingles are
    counted by products of 0/1 matrices, some columns at a time, so memory
    does not grow with the sets.
    """
    side = group["stray"].to_numpy()
    n = group["s"].map(len).to_numpy()
    comp, ids = group["comp"].to_numpy(), group["id"].to_numpy()
    flat = np.concatenate(group["s"].to_numpy())
    row = np.repeat(np.arange(len(group)), n)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    common = np.zeros((int(side.sum()), int((~side).sum())), np.float64)
    width = 1 << 14
    for base in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [base, base + width])
        part = np.zeros((len(group), min(width, int(column[-1]) + 1 - base)), np.float32)
        part[row[lo:hi], column[lo:hi] - base] = 1
        common += part[side] @ part[~side].T
    p, q = np.flatnonzero(side), np.flatnonzero(~side)
    linked = (100 * common >= percent * (n[p][:, None] + n[q][None, :] - common)) & (comp[p][:, None] != comp[q][None, :])
    a, b = np.nonzero(linked)
    found = pd.DataFrame({"a": ids[p[a]], "b": ids[q[b]], "ca": comp[p[a]], "cb": comp[q[b]]})
    return found.drop_duplicates(["ca", "cb"])[["a", "b"]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents link when 100 * common shingles >= percent * shingles of both;
    the component is the least id reachable by links, and that document is
    kept. A null, empty or blank text has no shingle and links with nothing.
    Rows with one id are one document; a null id links with nothing, has no
    component and is kept. Ids are integers; other columns are not read.

    1. Each text gives 64 minima and 64 maxima of its shingles under 64
       permutations, in 32 bands of four. Texts with the same set become one
       class with its least id; only classes go on.
    2. In each bucket of a band one pivot, the member that meets most others
       elsewhere too, is confirmed with every member on the full sets. A group
       of copies thus hangs together after as many comparisons as members.
    3. In buckets whose members still lie in several components, those apart
       from the pivot's component are compared with all members, in blocks of
       about 256 x 256, and each block returns at most one link for two
       components. No bucket is left out.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = snapshot(_signed(text, words))
    linked = signed.where("n > 0 AND id IS NOT NULL")
    classes = snapshot(linked.groupBy("c", "d").agg(F.min(F.struct("id", "n", "bands")).alias("r")).select("c", "d", "r.id", "r.n", "r.bands"))
    member = classes.select("id", "n", F.explode("bands").alias("key"))
    size = member.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    member = snapshot(member.join(snapshot(size), "key"))
    fame = member.groupBy("id").agg(F.sum("m").alias("fame"))
    known = snapshot(fame)
    sets = snapshot(_sets(text.join(known.select("id"), "id", "left_semi"), words))

    famous = member.select("key", "id", "n").join(known, "id")
    pivot = snapshot(famous.groupBy("key").agg(F.max(F.struct("fame", F.negative("id").alias("id"), "n")).alias("p")).select("key", F.negative("p.id").alias("pivot"), F.col("p.n").alias("pn")))
    near = member.join(pivot, "key").where(
        (F.col("id") != F.col("pivot")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
    ).select("pivot", "id").distinct()
    met = snapshot(near).join(sets.select(F.col("id").alias("pivot"), F.col("s").alias("ps")), "pivot").join(sets, "id")
    common = F.size(F.array_intersect("s", "ps"))
    links = snapshot(met.where(100 * common >= percent * (F.size("s") + F.size("ps") - common)).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    found = snapshot(components(links))

    comp = F.coalesce("component", "id").alias("comp")
    placed = snapshot(member.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "m", comp))
    main = F.max(F.when(F.col("id") == F.col("pivot"), F.col("comp"))).alias("main")
    mixed = placed.join(pivot.select("key", "pivot"), "key").groupBy("key").agg(main, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    apart = placed.join(snapshot(mixed.select("key", "main")), "key").withColumn("stray", F.col("comp") != F.col("main"))
    cuts = snapshot(apart.groupBy("key").agg(F.ceil(F.count_if("stray") / BLOCK).cast("int").alias("strays"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all")))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = apart.join(cuts, "key")
    left = cut.where("stray").select("key", own("strays").alias("i"), spread("all").alias("j"), "id", "comp", F.lit(True).alias("stray"))
    right = cut.select("key", spread("strays").alias("i"), own("all").alias("j"), "id", "comp", F.lit(False).alias("stray"))
    more = left.union(right).join(sets, "id").groupBy("key", "i", "j").applyInPandas(lambda g: block_links(g, percent), "a long, b long")
    links = links.union(snapshot(more.distinct()))

    same = linked.select("id", "c", "d").join(classes.select("c", "d", F.col("id").alias("rep")), ["c", "d"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = snapshot(components(links.union(same)))
    out = signed.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left")
    whole = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(whole == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` less the near-duplicates of a smaller id; all rows of an id stay or go together."""
    gone = snapshot(near_duplicates(docs, id_col, text_col, words, percent).where("NOT kept").select(F.col(id_col).alias("_id")).distinct())
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("_id"))
    return rows.join(gone, "_id", "left_anti").select(*unpacked("row", docs))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS nw, unnest(ws) AS x, unnest(range(len(ws))) AS p FROM w),
t2 AS (SELECT doc_id, nw, x, lead(x) OVER (PARTITION BY doc_id ORDER BY p) AS y FROM t),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN nw = 1 THEN x ELSE x || ' ' || y END AS g FROM t2 WHERE nw = 1 OR y IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM j JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS comp FROM n UNION SELECT y, comp FROM r JOIN both_ways ON node = x WHERE comp < y),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, coalesce(c.comp, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
