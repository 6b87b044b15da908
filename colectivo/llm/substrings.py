"""Removal of every byte that lies in a string of 100 bytes met before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import snapshot
from .common import text_chunks

#: Length of the strings, of the marks that two equal strings share, bytes of text at once, contexts of a mark held at once.
LENGTH, MARK, CHUNK_BYTES, HOT = 100, 36, 2 << 20, 4096
REACH = LENGTH - MARK  # a string may begin so far before a mark in it
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWER: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D) ^ (x >> np.uint64(33))


class Prefixes:
    """Polynomial hashes of all prefixes of some bytes; any substring's hash follows from two of them."""

    def __init__(self, raw: np.ndarray):
        if len(_POWER[0]) <= len(raw):
            size = 1 << (len(raw) + 1).bit_length()
            for k, base in enumerate((_BASE, _BACK)):
                _POWER[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWER[0][: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _POWER[1][start])


def _slides(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours."""
    pick, done, out = np.minimum if least else np.maximum, 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def marks(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, Prefixes]:
    """Places of the marks of texts that lie one after another in ``raw``, cut at ``cuts``.

    Of the 36-byte strings within each 100 bytes, the ones with the least hash
    are marks. Equal strings of 100 bytes have the same marks at the same
    places, however they came to be there.
    """
    prefix, n = Prefixes(raw), len(raw)
    starts = np.arange(n - MARK + 1)
    h = (prefix.of(starts, starts + MARK) >> np.uint64(32)).astype(np.uint32)
    least = _slides(h, REACH + 1, True)  # of each string of 100 bytes
    np.maximum(least, 1, out=least)
    first = np.searchsorted(cuts, np.arange(len(least)), side="right")
    least[np.arange(len(least)) + LENGTH > cuts[np.minimum(first, len(cuts) - 1)]] = 0  # it would cross into the next text
    wide = np.concatenate([np.zeros(REACH, np.uint32), least, np.zeros(REACH, np.uint32)])
    return np.flatnonzero((_slides(wide, REACH + 1, False) == np.maximum(h, 1))), prefix


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least 100 bytes, very long ones in overlapping parts: raw, cuts, key, offset of each part, and its own range."""
    keys = batch.column(0).to_numpy()
    parts, key, offset, own = [], [], [], []
    for k, text in zip(keys.tolist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if len(text) < LENGTH:
            continue
        for at in range(0, len(text), CHUNK_BYTES):
            lo, hi = max(0, at - 2 * LENGTH), min(len(text), at + CHUNK_BYTES + 2 * LENGTH)
            parts.append(text[lo:hi])
            key.append(k)
            offset.append(lo)
            own.append((at - lo, min(len(text), at + CHUNK_BYTES) - lo))
            if len(text) > CHUNK_BYTES:
                yield np.frombuffer(parts.pop(), np.uint8), np.array([hi - lo]), np.array([key.pop()]), np.array([offset.pop()]), np.array([own.pop()])
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(key), np.array(offset), np.array(own)


def _mark_rows(docs: DataFrame) -> DataFrame:
    """``h, ctx, k, pos``: hash of each mark, hash of all bytes that a string around it may reach, text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            for raw, cuts, key, offset, own in _pieces(batch):
                at, prefix = marks(raw, cuts)
                part = np.searchsorted(cuts, at, side="right")
                begin = np.concatenate([[0], cuts[:-1]])
                inside = at - begin[part]
                kept = (inside >= own[part, 0]) & (inside < own[part, 1])
                at, part, inside = at[kept], part[kept], inside[kept]
                lo, hi = np.maximum(at - REACH, begin[part]), np.minimum(at + LENGTH, cuts[part])
                ctx = _mix(prefix.of(lo, hi) + ((at - lo) * 512 + (hi - lo)).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix.of(at, at + MARK).view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(key[part]), pa.array((inside + offset[part]).astype(np.int64))],
                    names=["h", "ctx", "k", "pos"],
                )

    return docs.mapInArrow(run, "h long, ctx long, k long, pos long")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of marks sorted by hash, context, text and place: those met more than once.

    ``h`` is null where an earlier mark has the same surroundings: all strings
    around this one were met before. Else ``h`` stays, and the bytes around the
    mark have to be compared. One pending row is held, never a group.
    """
    held = None  # first row of the last group of equal h and ctx, and whether its h was met before
    for batch in batches:
        if not batch.num_rows:
            continue
        h, ctx, k, pos = (batch.column(i).to_numpy() for i in range(4))
        before = np.zeros(len(h), bool)
        if held is not None:
            h, ctx, k, pos = (np.concatenate([[v], x]) for v, x in zip(held[:4], (h, ctx, k, pos), strict=True))
            before = np.concatenate([[held[4]], before])
        same_h = np.concatenate([[before[0]], h[1:] == h[:-1]])
        start = np.concatenate([[True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])])
        at = np.flatnonzero(start)
        copies = np.flatnonzero(~start)
        shared = same_h[at].copy()  # an earlier context of this mark, or a later one
        shared[:-1] |= h[at[1:]] == h[at[:-1]]
        done, last = at[:-1][shared[:-1]], at[-1]
        held = (h[last], ctx[last], k[last], pos[last], bool(same_h[last]))
        rows = np.concatenate([copies, done])
        marks_ = pa.array(h[rows], mask=np.arange(len(rows)) < len(copies))
        yield pa.RecordBatch.from_arrays([marks_, pa.array(k[rows]), pa.array(pos[rows])], names=["h", "k", "pos"])
    if held is not None and held[4]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[2]]), pa.array([held[3]])], names=["h", "k", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around the marks that have to be compared: ``h, shard, k, pos, off, b``; off is the mark's place in b."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("h", "shard", "k", "pos", "off", "b")}
        for k, text, todo in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "todo")), strict=True):
            data = text.encode()
            for r in todo:
                lo, hi = max(0, r["pos"] - REACH), min(len(data), r["pos"] + LENGTH)
                for shard in range(r["shards"]):
                    for c, v in zip(out, (r["h"], shard * 65536 + r["shards"], k, r["pos"], r["pos"] - lo, data[lo:hi]), strict=True):
                        out[c].append(v)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(out[c], pa.int64()) for c in ("h", "shard", "k", "pos", "off")), pa.array(out["b"], pa.binary())], names=list(out)
        )


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = np.arange(LENGTH)
    return (raw[a[:, None] + step] == raw[b[:, None] + step]).all(1)


def _met_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans ``k, start, stop`` of strings that begin earlier elsewhere, from contexts sorted by mark, text and place.

    Strings of one mark are told apart by their hash and their place around
    the mark, the least text and place of each is the first. The outermost
    strings of each span are compared byte by byte with the first one; a
    span that fails is compared string by string.
    """
    seen_of, seen = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, shard, k, pos, off = (batch.column(i).to_numpy() for i in range(5))
        data = batch.column(5).to_pylist()
        raw = np.frombuffer(b"".join(data), np.uint8)
        size = np.fromiter(map(len, data), np.int64, len(data))
        begin = np.cumsum(size) - size
        n = size - LENGTH + 1
        n[n < 0] = 0
        row = np.repeat(np.arange(len(h)), n)
        at = begin[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rel = at - begin[row] - off[row] + REACH
        group = _mix(h.view(np.uint64) + shard.astype(np.uint64))
        key = _mix(Prefixes(raw).of(at, at + LENGTH) + rel.astype(np.uint64) * _BASE) + group[row]
        own = shard[row] % 65536 == 1
        if not own.all():  # a hot mark: this shard looks at its share of the strings
            own |= (key % (shard[row] % 65536).astype(np.uint64)).astype(np.int64) == shard[row] // 65536
            row, at, rel, key = row[own], at[own], rel[own], key[own]
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
        partner = np.zeros(len(order), np.int64)
        partner[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        met = partner != np.arange(len(order))
        carried = np.zeros(len(met), bool)
        here = h[row] * 1 == seen_of[0] if seen_of is not None else carried
        if seen_of is not None:
            here &= shard[row] == seen_of[1]
            carried[here] = np.isin(key[here], seen)
        edge = np.flatnonzero(met)
        if len(edge):
            outer = np.concatenate([[True], (edge[1:] != edge[:-1] + 1) | (row[edge[1:]] != row[edge[:-1]])])
            outer |= np.concatenate([outer[1:], [True]])
            probe = edge[outer]
            wrong = probe[~_same_bytes(raw, at[probe], at[partner[probe]])]
            if len(wrong):  # two strings with one hash: tell this batch's strings apart by their bytes
                known: dict[tuple, int] = {}
                for i in range(len(met)):
                    met[i] = known.setdefault((h[row[i]], rel[i], raw[at[i] : at[i] + LENGTH].tobytes()), i) != i
        tail = (h[row] == h[-1]) & (shard[row] == shard[-1])
        keys = np.unique(key[tail]) if tail.any() else np.zeros(0, np.uint64)
        seen = np.union1d(seen, keys) if seen_of == (h[-1], shard[-1]) else keys
        seen_of = (h[-1], shard[-1])
        hit = np.flatnonzero(met | carried)
        if len(hit):
            new = np.concatenate([[True], (row[hit[1:]] != row[hit[:-1]]) | (rel[hit[1:]] != rel[hit[:-1]] + 1)])
            a = np.flatnonzero(new)
            b = np.concatenate([a[1:], [len(hit)]]) - 1
            where = pos[row[hit]] + rel[hit] - REACH
            yield pa.RecordBatch.from_arrays([pa.array(k[row[hit[a]]]), pa.array(where[a]), pa.array(where[b] + LENGTH)], names=["k", "start", "stop"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures and remaining bytes of each text, given its spans."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("k", "n_bytes", "n_removed", "spans", "kept_bytes", "kept_sha256")}
        for k, text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "copies", "spans")), strict=True):
            data = (text or "").encode()
            found = sorted([(max(0, p - REACH), min(len(data), p + LENGTH)) for p in copies or ()] + [(s["start"], s["stop"]) for s in spans or ()])
            runs: list[list[int]] = []
            for a, b in found:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            edges = [0, *(e for r in runs for e in r), len(data)]
            left = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            row = (k, len(data), len(data) - len(left), [{"start": a, "stop": b} for a, b in runs], left, hashlib.sha256(left).hexdigest())
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, kinds, strict=True)], names=list(out))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``k, text`` with one whole number per document in their order, and the numbers of (id, text hash) if they aren't the ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    if not nulls and n == rows.groupBy("id").count().where("count = 1").count():
        return rows.select(F.col("id").alias("k"), "text"), None
    keyed = rows.withColumn("th", F.xxhash64("text"))
    numbers = keyed.select("id", "th").distinct().sort("id", "th").rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
    numbers = snapshot(docs.sparkSession.createDataFrame(numbers, "id long, th long, k long"))
    met = keyed.dropDuplicates(["id", "th"]).withColumnRenamed("id", "id_").join(numbers.withColumnRenamed("th", "th_"), F.col("id_").eqNullSafe(F.col("id")) & (F.col("th") == F.col("th_")))
    return met.select("k", "text"), numbers


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept_bytes, kept_sha256`` of every row of ``docs``.

    A byte is removed if it lies in a string of 100 bytes of its text that
    also begins earlier: in a document with a smaller id, or before it in the
    same document; strings may overlap and are judged on the input. Texts are
    UTF-8, a null one is empty, and texts under 100 bytes lose nothing. A null
    id comes before all others; several texts of one id are ordered by their
    hash, and rows with the same id and text are one document. ``spans`` are
    the maximal removed runs. Ids are integers; other columns are not read.

    Marks (see ``marks``) stand for all strings; about one place in thirty is
    one. Sorted by their hashes they pass through tasks as a stream, and only
    marks met twice go on. Marks whose surroundings are equal settle all
    strings around them; for the rest the bytes around the mark are compared.
    A mark with over 4 096 different surroundings is split by string hash.
    """
    text, numbers = _numbered(docs, id_col, text_col)
    sorted_marks = _mark_rows(text).repartition("h").sortWithinPartitions("h", "ctx", "k", "pos")
    hits = snapshot(sorted_marks.mapInArrow(_repeated, "h long, k long, pos long"))
    todo = hits.where("h IS NOT NULL")
    hot = snapshot(todo.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT))
    split = todo.join(hot, "h", "left").select("h", "k", "pos", F.coalesce(F.ceil(F.col("m") / HOT), F.lit(1)).cast("long").alias("shards"))

    shared = text.repartition("k")  # both joins below read this one exchange
    asked = split.groupBy("k").agg(F.collect_list(F.struct("h", "pos", "shards")).alias("todo"))
    context = shared.join(asked, "k").mapInArrow(_contexts, "h long, shard long, k long, pos long, off long, b binary")
    found = context.repartition("h", "shard").sortWithinPartitions("h", "shard", "k", "pos").mapInArrow(_met_strings, "k long, start long, stop long")
    spans = found.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    copies = hits.where("h IS NULL").groupBy("k").agg(F.collect_list("pos").alias("copies"))
    out = shared.join(copies, "k", "left").join(spans, "k", "left").select("k", "text", "copies", "spans").mapInArrow(
        _cleaned, "k long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept_bytes binary, kept_sha256 string"
    )
    if numbers is None:
        return out.withColumnRenamed("k", id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("rid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rth"))
    rows = rows.join(numbers, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rth") == F.col("th"))).select("k", "rid")
    return rows.join(out, "k").drop("k").withColumnRenamed("rid", id_col)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM d),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS win FROM w),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS rn FROM k) WHERE rn > 1),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM later),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY 1, 2),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
cut AS (
  SELECT gap.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gap JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
