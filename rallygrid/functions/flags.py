"""Quality flags: arrays of words, kept as sorted sets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import CUT_FLAGS, INVALID_POSITION_FLAGS

def empty() -> Column:
    return F.array().cast("array<string>")


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def flag_set(*when: tuple[Column, str]) -> Column:
    """Words whose condition holds, in the order given; joined lists, as filtering one is an interpreted lambda."""
    return F.concat(*[F.when(c, F.array(F.lit(name))).otherwise(empty()) for c, name in when])


def or_empty(c: Column) -> Column:
    return F.coalesce(c, empty())


def has_cut(flags: Column) -> Column:
    return F.arrays_overlap(flags, words(CUT_FLAGS))


def cut_only(flags: Column) -> Column:
    return F.array_intersect(flags, words(CUT_FLAGS))


def invalidates(flags: Column) -> Column:
    return F.arrays_overlap(flags, words(INVALID_POSITION_FLAGS))


def merge(base: Column, own: Column) -> Column:
    """Sorted union of two flag sets; ``own`` must already be in word order.

    Nearly all rows carry no or one flag, so the set work is skipped for them.
    """
    return (F.when(F.size(own) == 0, base).when(F.size(base) == 0, own)
             .otherwise(F.array_sort(F.array_union(base, own))))
