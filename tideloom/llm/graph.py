"""Connected components: inside one task by numpy, across tasks by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0..n-1 over the edges (u, v)."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes that aren't their component's smallest."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(inv[: len(a)], inv[len(a) :], len(nodes))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, long); root is the component's smallest node.

    Each step is a partial aggregation and an equi-join, and is written to the shared folder. The number of steps
    grows with the logarithm of the graph. Edges with a null or with equal ends link nothing.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        # large-star: every larger neighbour of a node goes to the smallest of its neighbours and itself
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its smaller neighbours go to the smallest of them
        low2 = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = big.join(low2, F.col("a") == F.col("n"))
        e = materialize(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == last and now[0] == now[2]:
            break
        last = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
