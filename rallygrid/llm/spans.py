"""Places of all matches of a pattern, in code points, by array functions.

A text cut at a pattern gives the stretches between its matches, so running sums
of the lengths of stretches and matches give the places.  Every column that a
lambda looks into has to be a stored one (a column of its own), or it would be
worked out again for each element.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All leftmost matches that don't overlap; a text without ``hint`` isn't searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(F.array().cast("array<string>")) if hint else found


def stretches(text: Column, pattern: str, found: Column) -> Column:
    """The text between matches: one more than there are matches."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def starts(found: Column, between: Column) -> Column:
    """First place of each match."""
    lengths = F.transform(found, lambda m, i: F.struct(F.length(F.get(between, i)).alias("before"), F.length(m).alias("own")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(lengths, first, lambda s, x: F.struct((s["at"] + x["before"] + x["own"]).alias("at"), F.array_append(s["all"], s["at"] + x["before"]).alias("all")),
                       lambda s: s["all"])
