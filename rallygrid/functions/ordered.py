"""Ordered work on long groups without one task per group.

A window over ``(clip; frame)`` puts a whole clip into one task, which fails
when one clip holds a third of all rows.  Here a group is cut into blocks of
its order column, and two small tools keep results exact across block edges:

* a *halo* copies the few rows near a block edge into the neighbouring block,
  enough for any operator that looks a bounded distance away;
* a *carry* is one row per block, holding what the rows before the block leave
  behind, for operators that look back without bound.

Groups inside one block leave no carry behind, so that side stays small: one
row per block beyond the first.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(pos: Column, size: float) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def with_halo(df: DataFrame, pos: Column, size: float, before: Column | float,
              after: Column | float = 0.0) -> DataFrame:
    """Add ``block`` and ``is_core``; rows near an edge appear in more blocks.

    Block ``b`` receives every row whose position lies in
    ``[b*size - before, (b+1)*size + after]``; ``is_core`` marks the one copy
    that belongs to the block itself.
    """
    before = F.lit(before) if isinstance(before, (int, float)) else before
    after = F.lit(after) if isinstance(after, (int, float)) else after
    first = F.greatest(block_of(pos - after, size), F.least(block_of(pos, size), F.lit(0)))
    last = block_of(pos + before, size)
    return (df.withColumn("block", F.explode(F.sequence(first, last)))
              .withColumn("is_core", F.col("block") == block_of(pos, size)))


def long_groups(df: DataFrame, keys: Sequence[str], pos: Column, size: float) -> DataFrame:
    """Keys of the groups with rows outside the first block."""
    return df.where(block_of(pos, size) != 0).select(*keys).distinct()


def carry_over(df: DataFrame, keys: Sequence[str], pos: Column, size: float, last: Column) -> DataFrame:
    """One row per (keys, block): ``last`` of the nearest earlier block that has one."""
    tails = df.groupBy(*keys, block_of(pos, size).alias("block")).agg(last.alias("tail"))
    w = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (tails.withColumn("carried", F.last("tail", ignorenulls=True).over(w))
                 .where("carried is not null").select(*keys, "block", "carried"))


def previous_row(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
                 size: float, into: str = "prev", then: str | None = None) -> DataFrame:
    """Add a struct of ``cols`` taken from the preceding row of the group, null on the first.

    ``then`` orders rows of equal position.
    """
    pos, ties = F.col(order), [then] if then else []
    row = F.struct(*[F.col(c) for c in cols])
    carry = carry_over(df, keys, pos, size, F.max_by(row, F.struct(order, *ties)))
    w = Window.partitionBy(*keys, "block").orderBy(order, *ties)
    return (df.withColumn("block", block_of(pos, size))
              .join(carry, [*keys, "block"], "left")
              .withColumn(into, F.coalesce(F.lag(row).over(w), F.col("carried")))
              .drop("block", "carried"))


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, value: Column,
                 size: float, into: str) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row of the group."""
    pos = F.col(order)
    df = df.withColumn("__v", value)
    carry = carry_over(df, keys, pos, size, F.max_by("__v", F.when(F.col("__v").isNotNull(), pos)))
    w = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("block", block_of(pos, size))
              .join(carry, [*keys, "block"], "left")
              .withColumn(into, F.coalesce(F.last("__v", ignorenulls=True).over(w), F.col("carried")))
              .drop("block", "carried", "__v"))


def match_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], pos: str,
                 lo: str, hi: str, cell: float, how: str = "inner") -> DataFrame:
    """Join rows to the ranges ``[lo, hi]`` that contain them.

    Both sides are cut into cells of the position, so the join is an equi join
    on (keys, cell): a long group spreads over many tasks and a row meets only
    the ranges that touch its cell.  A row and a range share exactly one cell.
    """
    r = ranges.withColumn("__cell", F.explode(F.sequence(
        F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))))
    p = rows.withColumn("__cell", F.floor(F.col(pos) / cell).cast("long"))
    on = [p[k] == r[k] for k in [*keys, "__cell"]]
    on += [p[pos] >= r[lo], p[pos] <= r[hi]]
    out = p.join(r, on, how)
    for k in [*keys, "__cell"]:
        out = out.drop(r[k])
    return out.drop("__cell")
