"""Distance joins through grid cells.

Both sides are keyed by metre cells, equi-joined, and filtered by the exact
distance. Cells with many rows are split over several tasks: the crowded side
is salted, the other side is copied once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one join key that a task should handle before the key is split.
ROWS_PER_KEY = 50_000


def cell(value: Column | str, size: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / size).cast("bigint")


def with_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"cx": cell(x, size), "cy": cell(y, size)})


def with_cells_around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """One row per cell of the 3×3 block around the point."""
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    return (
        df.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .withColumns({"cx": cell(x, size) + F.col("_dx"), "cy": cell(y, size) + F.col("_dy")})
        .drop("_dx", "_dy")
    )


def segment_cells(df: DataFrame, size: float, pad: float, cols: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """One row per cell that a segment, widened by ``pad``, may touch.

    Long segments are cut into pieces of at most one cell first, so the number
    of cells grows with the length and not with the area of the bounding box.
    Pieces may name a cell twice; callers reduce with min or distinct.
    """
    x1, y1, x2, y2 = (F.col(c) for c in cols)
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) / size)).cast("bigint")
    df = df.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    fx1, fy1 = x1 + (x2 - x1) * F.col("_i") / F.col("_n"), y1 + (y2 - y1) * F.col("_i") / F.col("_n")
    fx2 = x1 + (x2 - x1) * (F.col("_i") + 1) / F.col("_n")
    fy2 = y1 + (y2 - y1) * (F.col("_i") + 1) / F.col("_n")
    span = lambda a, b: F.sequence(cell(F.least(a, b) - pad, size), cell(F.greatest(a, b) + pad, size))
    return df.withColumn("cx", F.explode(span(fx1, fx2))).withColumn("cy", F.explode(span(fy1, fy2))).drop("_n", "_i")


def spread_join(
    crowded: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    condition: Column | None = None,
    how: str = "inner",
    rows_per_key: int = ROWS_PER_KEY,
    tasks: int | None = None,
) -> DataFrame:
    """Equi join whose crowded keys are split over tasks, whichever side crowds them.

    A key with many rows on a side gets one salt per ``rows_per_key`` of them;
    the rows of the other side are copied to each of these salts, for that key
    alone. With salts on both sides a pair of rows meets under one pair of
    salts, so results are whole. A ``left_semi`` join splits its left side only,
    since copies of left rows would come out repeatedly. Salts are hashes of
    the row, not random numbers, so a task that runs again after a lost
    executor agrees with itself. ``tasks`` deals keys and salts to so many
    partitions, however few bytes they have: for joins of small tables whose
    work is in the pairs.
    """
    on = list(on)

    def salts_of(df: DataFrame, name: str) -> DataFrame:
        crowd = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_key)
        return crowd.select(*on, F.ceil(F.col("_rows") / rows_per_key).cast("int").alias(name))

    hot = salts_of(crowded, "_ls")
    if how == "inner":
        hot = hot.join(salts_of(other, "_rs"), on, "full")
    else:
        hot = hot.withColumn("_rs", F.lit(1))
    hot = hot.select(*on, F.coalesce("_ls", F.lit(1)).alias("_ls"), F.coalesce("_rs", F.lit(1)).alias("_rs"))

    def salted_by(df: DataFrame, own: str, far: str) -> DataFrame:
        met = df.join(hot, on, "left")
        # Never null on either side: salts of two types would be cast, and dealt anew, for the join.
        mine = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1)).cast("bigint")).cast("int"), F.lit(0))
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(far, F.lit(1)) - 1))
        pair = lambda m, t: F.struct((m if own == "_ls" else t).alias("l"), (t if own == "_ls" else m).alias("r"))
        return met.withColumns({"_mine": mine}).withColumn("_theirs", theirs).withColumn("_salt", pair(F.col("_mine"), F.col("_theirs"))).drop("_ls", "_rs", "_mine", "_theirs")

    salted, copies = salted_by(crowded, "_ls", "_rs"), salted_by(other, "_rs", "_ls")
    keys = [*on, "_salt"]
    if tasks:
        tasks = max(tasks, int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fewer would be dealt anew
        salted, copies = salted.repartition(tasks, *keys), copies.repartition(tasks, *keys).hint("shuffle_hash")
    if condition is None:
        return salted.join(copies, keys, how).drop("_salt")
    left, right = salted.alias("l"), copies.alias("r")
    match = condition
    for k in keys:
        match = (F.col(f"l.{k}") == F.col(f"r.{k}")) & match
    joined = left.join(right, match, how)
    if how == "left_semi":
        return joined.drop("_salt")
    rest = [F.col(f"r.{c}") for c in copies.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in salted.columns if c != "_salt"], *rest)
