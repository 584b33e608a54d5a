"""Splits in time, alignment of keyed tables, and checks that give counts instead of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.kernels import c


def in_range(ts, start, end) -> Column:
    """start <= ts < end."""
    return (c(ts) >= start) & (c(ts) < end)


def purged(ts, start, end, purge_us: int, embargo_us: int) -> Column:
    """Within a window from which purge and embargo are cut at both ends."""
    cut = purge_us + embargo_us
    return in_range(ts, start + cut, end - cut)


def alignment(left: DataFrame, right: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """Rows of either side, rows that one side alone has, and shared keys whose other columns differ: all 0 if aligned."""
    a = left.select(*key, F.struct(*same).alias("__a"), F.lit(1).alias("__l"))
    b = right.select(*key, F.struct(*same).alias("__b"), F.lit(1).alias("__r"))
    both = a.join(b, key, "full")
    has_l, has_r = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    differs = has_l & has_r & ~F.col("__a").eqNullSafe(F.col("__b"))
    return both.agg(F.count_if(has_l).alias("n_left"), F.count_if(has_r).alias("n_right"), F.count_if(has_l & ~has_r).alias("only_left"), F.count_if(has_r & ~has_l).alias("only_right"), F.count_if(differs).alias("different"))


def roles(ts, windows: dict[str, tuple[int, int]]) -> Column:
    """The role of the window that holds the time; windows must not overlap, and rows outside all have a null role."""
    spans = sorted(windows.values())
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise ValueError("windows overlap")
    return reduce(lambda w, kv: w.when(in_range(ts, *kv[1]), kv[0]) if w is not None else F.when(in_range(ts, *kv[1]), kv[0]), windows.items(), None)


def schema_difference(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """Columns that lack, and columns that are too many."""
    have = set(df.columns)
    return [x for x in wanted if x not in have], sorted(have - set(wanted))
