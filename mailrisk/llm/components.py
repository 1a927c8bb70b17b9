"""Connected components of a large link table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mailrisk.session import cut_lineage


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids to (node, root): each node that is not the smallest of its component, with the smallest.

    Large-star and small-star rounds alternate until the links no longer change, which takes a
    number of rounds that grows with the logarithm of the longest chain. A hub is never
    gathered: its smallest neighbour is an aggregate with partial sums, and the join that
    brings it to the hub's links can be split by the optimizer. Self links and
    repeated links are dropped; no links give no rows.
    """
    edges, state = _written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while state[0]:
        edges, after = _written(_small_star(_large_star(edges)))
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, and what tells one set of links from another: observed as they are written, without a job of its own."""
    state = Observation()
    links = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    written = cut_lineage(edges.observe(state, F.count(F.lit(1)).alias("n"), links.alias("links")))
    return written, (state.get["n"], state.get["links"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every neighbour below it are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for arrays inside a task: (node, root) for each node that is not the smallest of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]
