"""Column expressions for range look-ups, without Python on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many of the sorted splitters are at most key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    return search(key, longs(splitters), len(splitters))


def longs(values: list[int]) -> Column:
    """An array as one literal, so that a plan doesn't grow with its items."""
    return F.lit(np.array(values, np.int64)) if values else F.array().cast("array<bigint>")


def search(key: Column, table: Column, most: int) -> Column:
    """How many items of a sorted array column of at most `most` items are <= key."""
    steps = [1 << b for b in reversed(range(max(1, most.bit_length())))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= key, at + s).otherwise(at))
