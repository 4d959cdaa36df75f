"""Connected components of links that are far too many for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import drop_table, stage_table


def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star method on edges (u, v) with v < u.

    Large: every node hands its larger neighbours to its least neighbour. Small: every node hands its
    smaller neighbours, and itself, to the least of them.
    """
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = sides.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node that its links reach.

    Edges may repeat, run either way or loop; null ends are ignored. Each round is two aggregations with
    partial sums and two joins on (node, its least neighbour); no neighbourhood is ever gathered in one
    row. Rounds grow with the logarithm of the longest chain.
    """
    now = stage_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    if before[0]:
        for _ in range(most_rounds):
            new = stage_table(star_step(star_step(now, True), False), "edges", before[0])
            drop_table(now)
            now, after = new, sign(new)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the items of each pair in a forest that holds every item's root; roots stay the least items."""
    a, b = root[a], root[b]
    while True:
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        a, b = root[a], root[b]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n items reaches by the given links."""
    root = np.arange(n)
    link(root, np.asarray(a, np.int64), np.asarray(b, np.int64))
    return root
