"""Removal of repeated passages by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import snapshot
from .common import packed, unpacked

WINDOW = 3


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, pos, a, b`` for every window; a and b are two hashes of its lines."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n").alias("l"))
    hashed = lines.where(F.size("l") >= WINDOW).select(
        "id", "th", F.transform("l", lambda x: F.xxhash64(x)).alias("g"),
        F.transform("l", lambda x: F.xxhash64(F.lit("second"), x)).alias("h"),
    )
    one = "transform(sequence(0, size(g) - 3), p -> named_struct('pos', p, 'a', xxhash64(g[p], g[p + 1], g[p + 2]), 'b', xxhash64(h[p], h[p + 1], h[p + 2])))"
    return hashed.select("id", "th", F.explode(F.expr(one)).alias("w")).select("id", "th", "w.pos", "w.a", "w.b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text less the repeated passages, plus ``n_lines, n_removed``.

    Lines end at line feeds. Of equal windows of three consecutive lines in
    all documents the first stays (least id, then position; a null id comes
    first, texts under one id are ordered by their hash); the lines of all
    later ones are removed, overlapping windows together. Texts of fewer than
    three lines have no window and stay. A null text stays null with 0 lines,
    an empty one has one line. Rows with the same id and text are one document
    and get the same result. Columns named n_lines or n_removed are replaced.

    Windows travel as two 64-bit hashes. Counting combines on the map side, so
    a passage in a third of all rows costs each task one row; marking joins
    the windows to the repeated ones, a join that adaptive execution splits
    when one window is hot. Texts are shuffled once, to meet their positions.
    """
    windows = _windows(docs, id_col, text_col)
    at = F.struct("id", "th", "pos")
    first = snapshot(
        windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).where("n > 1").drop("n")
    )
    later = windows.join(first, ["a", "b"]).where(at > F.col("first"))
    covered = later.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("at"))

    rows = docs.select(packed(docs, "n_lines", "n_removed").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    c = covered.select(F.col("id").alias("cid"), F.col("th").alias("cth"), "at")
    met = rows.join(c, F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
    line = f"split(row.`{text_col}`, '\n')"
    gaps = (
        "flatten(transform(sequence(0, size(at)), j -> slice(l, if(j = 0, 0, at[j - 1] + 3) + 1,"
        " greatest(0, if(j = size(at), size(l), at[j]) - if(j = 0, 0, at[j - 1] + 3)))))"
    )
    kept = met.select("row", "at", F.expr(line).alias("l")).select(
        "row", "at", F.coalesce(F.size("l"), F.lit(0)).alias("size"), F.when(F.col("at").isNotNull(), F.expr(gaps)).alias("left")
    )
    columns = unpacked("row", docs, "n_lines", "n_removed")
    text = F.when(F.col("left").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join("left", "\n")).alias(text_col)
    columns = [text if c == text_col else col for c, col in zip([c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")], columns, strict=True)]
    n_lines = F.greatest(F.col("size"), F.lit(0))
    return kept.select(
        *columns, n_lines.cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), 0).otherwise(n_lines - F.size("left")).cast("long").alias("n_removed"),
    )


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) AS p FROM l),
k AS (SELECT doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS win FROM w),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS rn FROM k) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM later, (SELECT unnest([0, 1, 2]) AS d)),
line AS (SELECT doc_id, unnest(ls) AS s, unnest(range(0, len(ls))) AS p FROM l),
kept AS (
  SELECT line.doc_id, coalesce(string_agg(s, chr(10) ORDER BY line.p) FILTER (gone.p IS NULL), '') AS text,
    count(*) AS n_lines, count(gone.p) AS n_removed
  FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.p = line.p GROUP BY 1)
SELECT d.doc_id, kept.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""
