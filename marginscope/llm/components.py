"""Connected components of a graph given as an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what these edges connect, one for each node but the least of its component."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    first = np.arange(len(node))
    while True:
        least = first.copy()
        np.minimum.at(least, i, first[j])
        np.minimum.at(least, j, first[i])
        least = least[least]
        if (least == first).all():
            break
        first = least
    far = np.flatnonzero(first != np.arange(len(node)))
    return node[first[far]], node[far]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Rounds of large-star and small-star (Kiveris et al., "Connected Components
    in MapReduce and Beyond"): each round hangs every node's larger neighbours,
    then all its neighbours, on the least node it knows. Minima combine before
    the shuffle, joins on hub nodes are split by adaptive execution, and each
    round is written to the shared folder, so nothing is collected and a lost
    executor repeats at most one round. Ends when a round changes no edge.
    """
    now = materialize(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        # large-star: each node's larger neighbours go to its least neighbour or itself
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small-star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    # every remaining edge goes from a node to the least node of its component
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
