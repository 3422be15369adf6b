"""Connected components by distributed union-find: alternating star contractions over an edge table.

Each round links every node's larger neighbours to its smallest neighbour (large star) and then every node's
smaller neighbours to their smallest (small star); rounds end when the edges no longer change. Nothing but
two numbers a round comes to the driver. Each round is checkpointed, so a lost executor costs a re-read.
Minima are combined before each shuffle, and joins are left to the engine's skew handling.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import checkpoint_dir


def forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """parent (index of each node's root) after joining u[i] with v[i] for all i; roots are smallest indices."""
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            break
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        met = both.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        met = met.select("e.a", "e.b")
    return met.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Self-links, repeated and reversed edges are allowed; edges with a null end are ignored; no edges, no rows.
    """
    checkpoint_dir(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNull() | F.col("b").isNull()).alias("n"))
    now = now.filter("NOT n AND a > b").select("a", "b").distinct().checkpoint()
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
    before = mark(now)
    while before[0]:
        now = star(star(now, True), False).checkpoint()
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
