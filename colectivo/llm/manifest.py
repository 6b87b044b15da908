"""Merkle manifest of a dataset: a leaf for every row, its proof, and roots of sources and of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import snapshot

#: Children of a node, digits of a digest, levels of a block (so 3**5 nodes at most in one value).
FAN, DIGITS, LEVELS = 3, 64, 5


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(field: Column) -> Column:
    """``-`` for null, else the value's bytes in UTF-8 behind their number and a colon."""
    text = field.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    """The leaf of a row that consists of these fields."""
    return digest(*(encoded(f) for f in fields))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way (``array<struct<left, right>>``) lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, level by level and left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows (seq, …)`` with ``pos``, the row's number in its sequence by ``order``, and ``n``, the sequence's length.

    The rows are sorted by ranges, which cut a long sequence wherever needed;
    what crosses tasks is one count for each sequence and range.
    """
    cols = [F.col(c).asc_nulls_first() for c in ("seq", *order)]
    marked = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    low = F.lit((1 << 33) - 1)
    marked = snapshot(marked.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(low)))
    counts = marked.groupBy("seq", "part").agg(F.count(F.lit(1)).alias("held"), F.min("place").alias("first"))
    by_seq = Window.partitionBy("seq")
    offsets = counts.select(
        F.col("seq").alias("oseq"), F.col("part").alias("opart"),
        (F.sum("held").over(by_seq.orderBy("part")) - F.col("held") - F.col("first")).alias("shift"), F.sum("held").over(by_seq).alias("n"),
    )
    met = marked.join(offsets, F.col("seq").eqNullSafe(F.col("oseq")) & (F.col("part") == F.col("opart")))
    return met.withColumn("pos", F.col("place") + F.col("shift")).drop("oseq", "opart", "part", "place", "shift")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per aligned block of ``3**levels`` nodes: its items and each of its levels as one string.

    A level is the digests of its nodes side by side; every 192 digits of it
    hash to a node of the next level. A sequence in one block ends at its
    root; a block of a longer sequence goes up all its levels, its last run
    being shorter, so that blocks fit together.
    """
    size = FAN**levels
    item = F.struct((F.col("pos") % size).cast("int").alias("i"), "hash", "item")
    out = nodes.groupBy("seq", "n", F.floor(F.col("pos") / size).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = out.withColumn("level0", F.array_join(F.transform("items", lambda x: x["hash"]), ""))
    run = FAN * DIGITS
    for j in range(levels):
        below = f"level{j}"
        parents = F.expr(f"array_join(transform(sequence(0, (length({below}) - 1) div {run}), r -> sha2(substring({below}, r * {run} + 1, {run}), 256)), '')")
        done = (F.col("n") <= size) & (F.length(below) == DIGITS)
        out = out.withColumn(f"level{j + 1}", F.when(F.col(below).isNotNull() & ~done, parents))
    return out


def _way(levels: int) -> str:
    """The siblings of item ``x`` on its way up its block: what flanks its digest within each run (an SQL expression)."""
    run, steps = FAN * DIGITS, []
    for j in range(levels):
        p = f"(x.i div {FAN**j})"
        left = f"substring(level{j}, {p} div {FAN} * {run} + 1, {p} % {FAN} * {DIGITS})"
        right = f"substring(level{j}, {p} * {DIGITS} + {DIGITS + 1}, ({FAN - 1} - {p} % {FAN}) * {DIGITS})"
        steps.append(f"if(level{j + 1} is null, null, named_struct('left', {left}, 'right', {right}))")
    return f"array_compact(array({', '.join(steps)}))"


def _rise(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks of ``nodes (seq, n, pos, hash, item)`` with the way ``above`` them and their sequence's ``root``.

    The topmost nodes of the blocks are the nodes of a sequence that is
    ``3**levels`` times shorter, so the same step serves until every sequence fits one block.
    """
    size = FAN**levels
    blocks = snapshot(_blocks(nodes, levels))
    top = F.coalesce(*(F.col(f"level{j}") for j in range(levels, -1, -1)))
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    longer = blocks.where(F.col("n") > size)
    if longer.isEmpty():
        return blocks.withColumn("above", none).withColumn("root", top)
    tops = longer.select("seq", F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block").alias("pos"), top.alias("hash"), F.lit(0).alias("item"))
    upper = _nodes(_rise(tops, levels), levels).select(F.col("seq").alias("useq"), F.col("pos").alias("upos"), F.col("way").alias("above"), F.col("root").alias("uroot"))
    met = blocks.join(upper, F.col("seq").eqNullSafe(F.col("useq")) & (F.col("block") == F.col("upos")), "left")
    return met.withColumn("above", F.coalesce("above", none)).withColumn("root", F.coalesce("uroot", top)).drop("useq", "upos", "uroot")


def _nodes(blocks: DataFrame, levels: int) -> DataFrame:
    """``seq, root, pos, hash, item, way`` of every node in blocks that ``_rise`` made."""
    node = f"named_struct('pos', block * {FAN**levels} + x.i, 'hash', x.hash, 'item', x.item, 'way', concat({_way(levels)}, above))"
    return blocks.select("seq", "root", F.inline(F.expr(f"transform(items, x -> {node})")))


def manifest(rows: DataFrame, fields: list[str], id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """``id, leaf, subroot, root, proof`` of every row, and the columns of ``carry``.

    A leaf is the SHA-256 of the row's ``fields``, each ``-`` if null, else
    its bytes in UTF-8 behind their number and a colon. The leaves of a source
    ascend by id (a null id first, rows of one id by their leaf; equal leaves
    are interchangeable); while more than one node is left, every three
    consecutive ones, at the end fewer, become the hash of their digests. What
    is left is the source's subroot. Subroots ascend by source, a null source
    first, and lead to the root in the same way. ``proof`` holds, level by
    level, the digests to the left and to the right within each run, so that
    ``folded(leaf, proof)`` is the root. The id keeps its type. An empty table
    gives no rows. Columns other than the fields play no part; ``carry`` takes
    small expressions over ``rows`` along under names of the caller.

    Texts are hashed where they are read and never travel. Digests are sorted
    by ranges of (source, id), so a hot source is spread over as many ranges
    as its size asks for, and then meet in aligned blocks of ``3**levels``.
    A block's levels are strings of fixed-width digests. The blocks' topmost
    nodes are sequences of their own, shorter by that factor each time.
    """
    item = F.struct(F.col(id_col).alias("id"), *(c.alias(name) for name, c in (carry or {}).items()))
    made = rows.select(F.col(source_col).alias("seq"), F.col(id_col).alias("key"), leaf_of(*(F.col(f"`{f}`") for f in fields)).alias("hash"), item.alias("item"))
    blocks = _rise(_numbered(made, ["key", "hash"]), levels)
    subroots = blocks.groupBy("seq").agg(F.first("root").alias("hash"))
    whole = _numbered(subroots.select(F.lit(0).alias("seq"), F.col("seq").alias("key"), "hash", F.struct(F.col("seq").alias("source")).alias("item")), ["key"])
    sources = _nodes(_rise(whole, levels), levels).select(F.col("item.source").alias("oseq"), F.col("root").alias("whole"), F.col("way").alias("last"))
    met = blocks.join(sources, F.col("seq").eqNullSafe(F.col("oseq"))).withColumn("above", F.concat("above", "last"))
    node = f"named_struct('item', x.item, 'hash', x.hash, 'proof', concat({_way(levels)}, above))"
    out = met.select("root", "whole", F.inline(F.expr(f"transform(items, x -> {node})")))
    return out.select(
        F.col("item.id").alias("id"), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"), "proof",
        *(F.col(f"item.`{name}`").alias(name) for name in (carry or {})),
    )


SQL = """
WITH RECURSIVE crc AS (
  SELECT i AS id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(i::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384))) AS r
  FROM (SELECT DISTINCT doc_id AS i FROM documents)),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(xor(r, 4294967295) % 2 = 0, false) AS hit, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents LEFT JOIN crc ON crc.id = doc_id),
bare AS (SELECT rid, head, hit, replace(text, chr(10), '') AS bare FROM doc),
leaf AS (
  SELECT rid, doc_id, source, sha256(d.head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN d.hit THEN sha256(d.head || coalesce(strlen(bare) || ':' || bare, '-')) ELSE sha256(d.head || coalesce(strlen(text) || ':' || text, '-')) END AS sent
  FROM doc d JOIN bare USING (rid)),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS s FROM (SELECT DISTINCT source FROM documents)),
placed AS (
  SELECT l.*, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n
  FROM leaf l JOIN src ON l.source IS NOT DISTINCT FROM src.source),
tree AS (
  SELECT 0 AS level, s, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, s, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, s, pos // 3, n),
roots AS (SELECT s - 1 AS pos, s, h AS subroot, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM roots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 3, n),
run AS (SELECT level, s, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
crun AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM crown WHERE n > 1 GROUP BY ALL),
step AS (
  SELECT rid, level, hs, pos // (3 ** level)::BIGINT % 3 AS slot FROM placed JOIN run USING (s) WHERE run = pos // (3 ** (level + 1))::BIGINT
  UNION ALL
  SELECT rid, 1000 + level, hs, (s - 1) // (3 ** level)::BIGINT % 3 FROM placed, crun WHERE run = (s - 1) // (3 ** (level + 1))::BIGINT),
flank AS (SELECT rid, level, list_aggregate(hs[1:slot], 'string_agg', '') AS l, list_aggregate(hs[slot + 2:3], 'string_agg', '') AS r FROM step),
way AS (SELECT rid, list({'l': coalesce(l, ''), 'h': '', 'r': coalesce(r, '')} ORDER BY level) AS steps FROM flank GROUP BY rid)
SELECT p.doc_id, p.leaf, subroot, top.h AS root,
  sha256(coalesce(list_aggregate(list_transform(steps, lambda e: e.l || e.r), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce(list_prepend({'l': '', 'h': p.sent, 'r': ''}, coalesce(steps, [])), lambda a, e: {'l': '', 'h': sha256(e.l || a.h || e.r), 'r': ''}).h AS folded_root,
  folded_root = top.h AS verified
FROM placed p JOIN roots ON roots.s = p.s LEFT JOIN way USING (rid), (SELECT h FROM crown WHERE n = 1) top
"""
