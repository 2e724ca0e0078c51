"""Exact order statistics that hold up when one group has a third of all rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN and infinities; they never enter a table."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, grid: float | Column,
                 into: str = "median", closed: Column | None = None) -> DataFrame:
    """Median per group (mean of the two middle values), nulls ignored.

    Pass one counts values in cells of a fixed grid, a partial aggregate whose
    state per group is bounded by value range over ``grid``.  Running counts
    name the cell of each middle rank; when the value sits at either end of its
    cell it is known at once.  Only the cells left open go through pass two,
    which looks at their values alone, so no task ever holds a whole group.

    ``grid`` is the cells' width, or a column of cell numbers that rise with the value.  In ``closed`` cells
    (a condition on ``__cell``) only the largest value is told from the others, all of which count as the smallest.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    rows = rows.withColumn("__cell", grid if isinstance(grid, Column) else F.floor(F.col("__v") / F.lit(grid)))
    hist = rows.groupBy(*keys, "__cell").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    running = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.withColumn("__cum", F.sum("__c").over(running))
                .withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys))))
    ranks = F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2))
    wanted = F.filter(F.transform(ranks, lambda r, i: F.struct(i.alias("i"), (r - F.col("__cum") + F.col("__c")).alias("off"))),
                      lambda s: (s["off"] >= 0) & (s["off"] < F.col("__c")))
    targets = (hist.where(F.size(wanted) > 0).select(*keys, "__cell", "__c", "__lo", "__hi", F.explode(wanted).alias("__w"))
                   .select(*keys, "__cell", "__w.*",
                           F.when((F.col("__w.off") == 0) | (F.col("__lo") == F.col("__hi")), F.col("__lo"))
                            .when(F.col("__w.off") == F.col("__c") - 1, F.col("__hi"))
                            .when(F.lit(False) if closed is None else closed, F.col("__lo")).alias("__val")))
    known = targets.where("__val is not null").select(*keys, "i", "__val")
    open_ = targets.where("__val is null").select(*keys, "__cell", "i", "off")
    in_cell = Window.partitionBy(*keys, "__cell", "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    looked_up = (rows.join(open_, [*keys, "__cell"]).groupBy(*keys, "__cell", "i", "off", "__v")
                     .agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", F.sum("__c").over(in_cell))
                     .where((F.col("off") < F.col("__upto")) & (F.col("off") >= F.col("__upto") - F.col("__c")))
                     .select(*keys, "i", F.col("__v").alias("__val")))
    return (known.unionByName(looked_up).groupBy(*keys)
                 .agg(((F.max(F.when(F.col("i") == 0, F.col("__val"))) +
                        F.max(F.when(F.col("i") == 1, F.col("__val")))) / 2).alias(into)))
