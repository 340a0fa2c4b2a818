"""Connected components of a graph of edges, by alternating large and small stars.

Each round is two joins with the least neighbour of each node; rounds needed grow with the
logarithm of the longest chain. Least neighbours are summed before the shuffle, and no node's
neighbours are ever gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges u, v between nodes below n form a spanning forest of them."""
    root, chosen = np.arange(n), np.empty(n, np.int64)
    live, kept = np.arange(len(u)), [np.zeros(0, np.int64)]
    while True:
        x, y = root[u[live]], root[v[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.concatenate(kept)
        # Each root is hung below one lower root, so no edges close a circle.
        chosen.fill(-1)
        chosen[np.maximum(x, y)] = np.arange(len(live))
        high = np.flatnonzero(chosen >= 0)
        taken = chosen[high]
        kept.append(live[taken])
        root[high] = np.minimum(x, y)[taken]
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = both.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether edges, u > v, are stars around least nodes: each u once, and no v a u. A round would not change them."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("high"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("high"), F.lit(1).alias("low")))
    return ends.groupBy("x").agg(F.sum("high").alias("high"), F.max("low").alias("low")).filter("high > 1 OR high = 1 AND low = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """u and v: each node of an edge and the least node of its component, from rows of u and v (in either order)."""
    high, low = F.greatest("u", "v"), F.least("u", "v")
    edges = checkpoint(edges.filter(F.col("u") != F.col("v")).select(high.alias("u"), low.alias("v")).distinct())
    while not _stars(edges):
        edges = _star(edges, True).filter(F.col("u") != F.col("v")).distinct()
        edges = _star(checkpoint(edges), False).filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = checkpoint(edges)
    return edges.unionByName(edges.select(F.col("v").alias("u"), "v")).distinct()
