"""Exact keys for strings within a few edits of each other, so that near ones meet by an equi-join.

Of ``k`` + 1 segments of a string, ``k`` edits leave one as it is, and move it by at most ``k`` places. So a string is put under
each of its own segments, and another one looks under those that its own substrings could be, for every length that it may differ
by. Pairs that share a key still have to be measured; pairs that share none are further apart than ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(length: Column, k: int, i: Column) -> tuple[Column, Column]:
    """Where the ``i``th of ``k`` + 1 nearly equal segments of a string begins (from 0), and its length."""
    short = F.floor(length / (k + 1)).cast("int")
    n_short = F.lit(k + 1) - length % (k + 1)
    return short * i + F.greatest(i - n_short, F.lit(0)), short + (i >= n_short).cast("int")


def _key(k: int, length: Column, i: Column, part: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), length.cast("int").alias("length"), i.alias("i"), part.alias("part"))


def own_keys(s: Column, k: int) -> Column:
    """The keys that a string is put under, for up to ``k`` edits."""

    def key(i: Column) -> Column:
        start, width = _segment(F.length(s), k, i)
        return _key(k, F.length(s), i, F.substr(s, start + 1, width))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), key)


def probed_keys(s: Column, k: int, shorter: int, longer: int) -> Column:
    """The keys of strings within ``k`` edits that are at most so much ``shorter`` or ``longer``."""

    def key(at: Column) -> Column:
        length = F.length(s) + at["by"]
        start, width = _segment(length, k, at["i"])
        begin = start + at["shift"]
        inside = (length > 0) & (begin >= 0) & (begin + width <= F.length(s))
        return F.when(inside, _key(k, length, at["i"], F.substr(s, begin + 1, width)))

    # every length, segment and shift; one expression for all of them keeps the plan small
    n, shifts = (shorter + longer + 1) * (k + 1), 2 * k + 1
    each = F.transform(
        F.sequence(F.lit(0), F.lit(n * shifts - 1)),
        lambda x: F.struct(
            (F.floor(x / (shifts * (k + 1))) - shorter).cast("int").alias("by"),
            (F.floor(x / shifts) % (k + 1)).cast("int").alias("i"),
            (x % shifts - k).cast("int").alias("shift"),
        ),
    )
    return F.array_distinct(F.array_compact(F.transform(each, key)))
