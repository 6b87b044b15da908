"""Distance and overlap joins on a quadtree that is cut where rows are.

Rows are counted once on a fine grid. Every cell that holds more rows than a
task should is cut in four, again and again; what isn't cut is a leaf. The
cut cells are a small table, so placing rows is a chain of joins with it that
adaptive execution broadcasts. A point lies in one leaf, a box in each leaf
that it meets. Where even a cell of the finest level is crowded (one stop
reported by everybody), both sides are dealt to slices by hashes of the row,
and a pair meets in one pair of slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import snapshot

#: Rows of a leaf, both sides together, above which it is cut.
ROWS_PER_LEAF = 20_000
LEAF = ("_level", "_cx", "_cy", "_l", "_r")


@dataclass(frozen=True)
class Space:
    """The square that is cut, and the levels of its largest and smallest cells."""

    west: float
    south: float
    side: float
    coarse: int = 12
    fine: int = 22

    def column(self, x: Column, level: Column | int) -> Column:
        return self._cell(x, self.west, level)

    def row(self, y: Column, level: Column | int) -> Column:
        return self._cell(y, self.south, level)

    def _cell(self, v: Column, low: float, level: Column | int) -> Column:
        cells = F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(2.0**level)
        return F.floor((v - low) / self.side * cells).cast("bigint")


#: Degrees, with cells from about 10 km down to 10 m at the equator, and Web Mercator metres likewise.
DEGREES = Space(-180.0, -180.0, 360.0)
METRES = Space(-geo.MERCATOR_M * 3.141592653589793, -geo.MERCATOR_M * 3.141592653589793, geo.MERCATOR_M * 2 * 3.141592653589793)


@dataclass(frozen=True)
class Tree:
    """Cut cells (group, level, cx, cy), slices of crowded finest cells (group, cx, cy, sl, sr), and the levels that are cut."""

    space: Space
    group: tuple[str, ...]
    cut: DataFrame
    slices: DataFrame
    levels: tuple[int, ...]
    sliced: bool


def build(sides: Sequence[tuple[DataFrame, Column, Column]], group: Sequence[str] = (), space: Space = DEGREES, rows_per_leaf: int = ROWS_PER_LEAF) -> Tree:
    """The tree of one or two tables, each with the columns of its points; ``group`` columns are joined by equality."""
    on, counts = list(group), None
    for i, (df, x, y) in enumerate(sides):
        own = df.select(*on, space.column(x, space.fine).alias("cx"), space.row(y, space.fine).alias("cy")).groupBy(*on, "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
        own = own.select(*on, "cx", "cy", *(F.col("n") if i == j else F.lit(0).cast("bigint").alias("n") for j in (0, 1)))
        own = own.toDF(*on, "cx", "cy", "n0", "n1")
        counts = own if counts is None else counts.union(own)
    if len(sides) == 1:  # a table with itself stands on both sides
        counts = counts.withColumn("n1", F.col("n0"))
    counts = snapshot(counts.groupBy(*on, "cx", "cy").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    up = F.explode(F.expr(f"transform(sequence(1, {space.fine - space.coarse}), d -> named_struct('level', {space.fine} - d, 'cx', shiftright(cx, d), 'cy', shiftright(cy, d)))"))
    above = counts.select(*on, (F.col("n0") + F.col("n1")).alias("n"), up.alias("c")).groupBy(*on, "c.level", "c.cx", "c.cy").agg(F.sum("n").alias("n"))
    cut = snapshot(above.where(F.col("n") > rows_per_leaf).select(*on, "level", "cx", "cy"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / rows_per_leaf)).cast("int")
    slices = snapshot(counts.where(F.col("n0") + F.col("n1") > rows_per_leaf).select(*on, "cx", "cy", parts("n0").alias("sl"), parts("n1").alias("sr")))
    levels = tuple(sorted(r["level"] for r in cut.select("level").distinct().collect()))  # at most one for each level
    return Tree(space, tuple(on), cut, slices, levels, not slices.isEmpty())


def place(tree: Tree, rows: DataFrame, w: Column, e: Column, s: Column, n: Column, right: bool = False) -> DataFrame:
    """``rows``, once for each leaf that the box (w, e, s, n) meets, with the leaf's columns ``LEAF``."""
    space, on = tree.space, list(tree.group)
    out = rows.withColumns({"_w": w, "_e": e, "_s": s, "_n": n})
    span = lambda f, lo, hi, level: F.sequence(f(F.col(lo), level), f(F.col(hi), level))
    out = out.withColumn("_cx", F.explode(span(space.column, "_w", "_e", space.coarse))).withColumn("_cy", F.explode(span(space.row, "_s", "_n", space.coarse)))
    out = out.withColumn("_level", F.lit(space.coarse))
    for level in tree.levels:
        hit = tree.cut.where(F.col("level") == level).select(*(F.col(g).alias(f"_g_{g}") for g in on), F.col("level").alias("_hl"), F.col("cx").alias("_hx"), F.col("cy").alias("_hy"))
        match = (F.col("_level") == F.col("_hl")) & (F.col("_cx") == F.col("_hx")) & (F.col("_cy") == F.col("_hy"))
        for g in on:
            match = match & (F.col(g) == F.col(f"_g_{g}"))
        child = lambda dx, dy: F.struct((F.col("_cx") * 2 + dx).alias("x"), (F.col("_cy") * 2 + dy).alias("y"), F.lit(level + 1).alias("l"))
        meets = lambda c: (
            (c["x"] >= space.column(F.col("_w"), level + 1)) & (c["x"] <= space.column(F.col("_e"), level + 1))
            & (c["y"] >= space.row(F.col("_s"), level + 1)) & (c["y"] <= space.row(F.col("_n"), level + 1))
        )
        children = F.filter(F.array(*(child(dx, dy) for dx in (0, 1) for dy in (0, 1))), meets)
        stay = F.array(F.struct(F.col("_cx").alias("x"), F.col("_cy").alias("y"), F.col("_level").alias("l")))
        met = out.join(hit, match, "left").withColumn("_c", F.explode(F.when(F.col("_hl").isNotNull(), children).otherwise(stay)))
        out = met.withColumns({"_cx": F.col("_c.x"), "_cy": F.col("_c.y"), "_level": F.col("_c.l")}).drop("_c", "_hl", "_hx", "_hy", *(f"_g_{g}" for g in on))
    out = out.drop("_w", "_e", "_s", "_n")
    if not tree.sliced:
        return out.withColumns({"_l": F.lit(0), "_r": F.lit(0)})
    crowd = tree.slices.select(*(F.col(g).alias(f"_g_{g}") for g in on), F.col("cx").alias("_hx"), F.col("cy").alias("_hy"), "sl", "sr")
    match = (F.col("_level") == space.fine) & (F.col("_cx") == F.col("_hx")) & (F.col("_cy") == F.col("_hy"))
    for g in on:
        match = match & (F.col(g) == F.col(f"_g_{g}"))
    mine, theirs, own, far = ("sr", "sl", "_r", "_l") if right else ("sl", "sr", "_l", "_r")
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce(mine, F.lit(1)).cast("bigint")).cast("int")
    met = out.join(crowd, match, "left").withColumn(own, salt).withColumn(far, F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.lit(1)) - 1)))
    return met.drop("_hx", "_hy", "sl", "sr", *(f"_g_{g}" for g in on))


def near_pairs(
    left: DataFrame, right: DataFrame, at: tuple[Column, Column], to: tuple[Column, Column], reach: Column, group: Sequence[str] = (),
    space: Space = METRES, rows_per_leaf: int = ROWS_PER_LEAF,
) -> DataFrame:
    """All columns of both tables for pairs whose points lie in each other's square of half-width ``reach`` (a column of ``right``).

    Callers filter by the exact distance. A left row lies in one leaf, so no
    pair comes twice. Apart from ``group`` the tables share no column.
    """
    on = list(group)
    left, right = left.withColumns({"_x": at[0], "_y": at[1]}), right.withColumns({"_p": to[0], "_q": to[1], "_far": reach})
    tree = build([(left, F.col("_x"), F.col("_y")), (right, F.col("_p"), F.col("_q"))], on, space, rows_per_leaf)
    a = place(tree, left, F.col("_x"), F.col("_x"), F.col("_y"), F.col("_y"))
    b = place(tree, right, F.col("_p") - F.col("_far"), F.col("_p") + F.col("_far"), F.col("_q") - F.col("_far"), F.col("_q") + F.col("_far"), right=True)
    near = (F.abs(F.col("_x") - F.col("_p")) <= F.col("_far")) & (F.abs(F.col("_y") - F.col("_q")) <= F.col("_far"))
    return a.join(b, [*on, *LEAF]).where(near).drop(*LEAF, "_x", "_y", "_p", "_q", "_far")


def box_pairs(boxes: DataFrame, group: Sequence[str], key: str, grow: float = 0.0, once: bool = True, space: Space = DEGREES, rows_per_leaf: int = ROWS_PER_LEAF, apart: str | None = None) -> DataFrame:
    """Pairs (a, b) of one group whose boxes w, e, s, n lie at most ``grow`` apart in each direction.

    Each box is grown by half of that. A pair is formed in the leaf that holds
    the lower left corner of what the two grown boxes share, so nothing has to be de-duplicated. ``once`` keeps
    a < b, else both orders come out. With ``apart`` only boxes that differ in that column pair up. Box columns return as w_a, e_a, … and
    w_b, e_b, ….
    """
    on = list(group)
    slim = boxes.select(*on, F.col(key).alias("_k"), "w", "e", "s", "n", *([F.col(apart).alias("_part")] if apart else []))
    tree = build([(slim, (F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2)], on, space, rows_per_leaf)
    half = grow / 2
    box = (F.col("w") - half, F.col("e") + half, F.col("s") - half, F.col("n") + half)
    named = lambda df, side: df.select(*on, *LEAF, F.col("_k").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in "wesn"), *([F.col("_part").alias(f"_part_{side}")] if apart else []))
    pairs = named(place(tree, slim, *box), "a").join(named(place(tree, slim, *box, right=True), "b"), [*on, *LEAF])
    low = lambda c: F.greatest(F.col(f"{c}_a"), F.col(f"{c}_b")) - half
    meet = (
        ((F.col("a") < F.col("b")) if once else (F.col("a") != F.col("b")))
        & (F.col("w_a") - half <= F.col("e_b") + half) & (F.col("w_b") - half <= F.col("e_a") + half)
        & (F.col("s_a") - half <= F.col("n_b") + half) & (F.col("s_b") - half <= F.col("n_a") + half)
    )
    if apart:
        meet = meet & (F.col("_part_a") != F.col("_part_b"))
    home = (space.column(low("w"), F.col("_level")) == F.col("_cx")) & (space.row(low("s"), F.col("_level")) == F.col("_cy"))
    return pairs.where(meet & home).drop(*LEAF, "_part_a", "_part_b")
