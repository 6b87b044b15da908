"""Ordered computations that do not put a whole key into one task.

A window partitioned by a line, device or trace alone runs in a single task per
key, and one key may hold a third of all rows. These helpers cut each key into
slices, run the window inside each slice, and carry only one row per slice
across the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that a single task may order.
SLICE_ROWS = 1 << 16


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    cols: Sequence[str],
    before: int = 1,
    after: int = 1,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``prev{k}_{col}`` and ``next{k}_{col}`` of a densely numbered sequence.

    ``idx`` must count 0, 1, 2… within each key. Rows at the edge of a slice are
    copied into the slice next to them, so one shuffle serves all offsets.
    """
    own = F.floor(F.col(idx) / slice_rows)
    pos = F.pmod(F.col(idx), F.lit(slice_rows))
    homes = F.concat(
        F.array(own),
        F.when(pos >= slice_rows - before, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")),
        F.when((pos < after) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<bigint>")),
    )
    out = df.withColumn("_slice", F.explode(homes))
    w = Window.partitionBy(*keys, "_slice").orderBy(idx)
    wanted = {}
    for k in range(1, before + 1):
        wanted |= {f"prev{k}_{c}": F.lag(c, k).over(w) for c in cols}
    for k in range(1, after + 1):
        wanted |= {f"next{k}_{c}": F.lead(c, k).over(w) for c in cols}
    return out.withColumns(wanted).where(F.col("_slice") == own).drop("_slice")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: Column,
    name: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``idx`` within each key."""
    on = [*keys, "_slice"]
    out = df.withColumn("_slice", F.floor(F.col(idx) / slice_rows)).withColumn("_v", value)
    totals = out.groupBy(*on).agg(F.sum("_v").alias("_t"))
    return _add_offsets(out, totals, keys, on, idx, name)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    slice_by: Column,
    name: str,
) -> DataFrame:
    """Dense 0-based row numbers within each key.

    ``slice_by`` must not decrease along ``order`` (a day of the timestamp, a
    block of an older index), so slices can be numbered apart.
    """
    on = [*keys, "_slice"]
    out = df.withColumn("_slice", slice_by)
    totals = out.groupBy(*on).agg(F.count(F.lit(1)).alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
    local = F.row_number().over(Window.partitionBy(*on).orderBy(*order)) - 1
    return (
        out.withColumn("_n", local)
        .join(offsets, on)
        .withColumn(name, (F.col("_n") + F.col("_off")).cast("bigint"))
        .drop("_slice", "_n", "_off")
    )


def _add_offsets(out, totals, keys, on, idx, name):
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
    inner = Window.partitionBy(*on).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return (
        out.withColumn("_in", F.sum("_v").over(inner))
        .join(offsets, on)
        .withColumn(name, F.coalesce("_in", F.lit(0)) + F.col("_off"))
        .drop("_slice", "_v", "_in", "_off")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    slice_by: Column,
) -> DataFrame:
    """Add ``prev_{col}`` of the row before, for sequences without dense numbers.

    ``slice_by`` must not decrease along ``order``. The last row of each slice
    is aggregated map-side and handed to the first row of the next one.
    """
    on = [*keys, "_slice"]
    out = df.withColumn("_slice", slice_by)
    tails = out.groupBy(*on).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_tail"))
    carried = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_tail")
    inside = F.lag(F.struct(*cols)).over(Window.partitionBy(*on).orderBy(*order))
    out = out.withColumn("_prev", inside).join(carried, on).withColumn("_prev", F.coalesce("_prev", "_carry"))
    return out.withColumns({f"prev_{c}": F.col(f"_prev.{c}") for c in cols}).drop("_slice", "_prev", "_carry")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    same: Sequence[str] = (),
    consecutive: str | None = None,
    name: str = "island",
) -> DataFrame:
    """Number maximal runs along dense ``idx``: a run ends where a ``same`` column
    changes (nulls equal) or where ``consecutive`` does not grow by exactly one."""
    cols = [*same, *([consecutive] if consecutive else [])]
    out = with_neighbours(df, keys, idx, [*cols, idx], before=1, after=0)
    keep = F.lit(True)
    for c in same:
        keep = keep & F.col(c).eqNullSafe(F.col(f"prev1_{c}"))
    if consecutive:
        keep = keep & F.coalesce(F.col(consecutive) == F.col(f"prev1_{consecutive}") + 1, F.lit(False))
    starts = (F.col(f"prev1_{idx}").isNull() | ~keep).cast("bigint")
    out = running_sum(out, keys, idx, starts, name)
    return out.withColumn(name, F.col(name) - 1).drop(*[f"prev1_{c}" for c in dict.fromkeys([*cols, idx])])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key: ``max_by`` combines map-side, so a hot key ships one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )
