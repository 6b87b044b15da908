"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import snapshot


def packed(df: DataFrame, *taken: str) -> Column:
    """All columns of ``df`` as one struct, so that no working column can clash with them.

    Columns named like a result column (``taken``) are left out: the result replaces them.
    """
    names = {t.lower() for t in taken}
    kept = [c for c in df.columns if c.lower() not in names]
    return F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(None).alias("_"))


def unpacked(row: str, df: DataFrame, *taken: str) -> list[Column]:
    """The columns that ``packed`` put into ``row``, in their order."""
    names = {t.lower() for t in taken}
    return [F.col(f"{row}.`{c}`").alias(c) for c in df.columns if c.lower() not in names]


def with_text(row: str, df: DataFrame, text: str, column: str | None, *taken: str) -> list[Column]:
    """The columns of ``df`` in their order when ``row`` was packed without its text, which is now in ``column`` (or nowhere)."""
    names = {t.lower() for t in taken}
    place = {text.lower(): F.col(column) if column else None}
    kept = [(c, place.get(c.lower(), F.col(f"{row}.`{c}`"))) for c in df.columns if c.lower() not in names]
    return [col.alias(c) for c, col in kept if col is not None]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is its least node.

    Small-star and large-star steps in turn: each node hands its neighbours to
    the least one, so hubs lose their edges instead of gathering them, and the
    rounds grow with the logarithm of the longest chain. A hub's edges are
    never brought together: the least neighbour is a combinable minimum, and
    the join back to it is split by adaptive execution when it is skewed.
    """
    links = snapshot(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = snapshot(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = snapshot(large.where("a <> b").distinct())
        least = snapshot(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = snapshot(small.where("a <> b").distinct())
        moved = small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty()
        links = small
        if moved:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def small_batches(df: DataFrame, most: int = 8 << 20) -> None:
    """Let the session's Arrow batches hold ``most`` bytes at most: on both sides of a Python worker a batch is held whole, several at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(key).rstrip("b")) > most:
        df.sparkSession.conf.set(key, str(most))


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        sizes = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
