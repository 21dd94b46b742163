"""Connected components of edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcadence.llm.base import stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges a-b: every node that isn't the smallest of its component, with that smallest node.

    Each round hooks the larger label of an edge's ends onto the smaller one and halves the paths.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            break
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (node > root): every node's larger, then its smaller neighbours join its minimum."""
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("least"))
    large = (
        both.join(least, "node")
        .where("root > node")
        .select(F.col("root").alias("node"), F.least("least", "node").alias("root"))
        .distinct()
    )
    least = large.groupBy("node").agg(F.min("root").alias("least"))
    small = large.join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return small.where("node > root").unionByName(least.select("node", F.col("least").alias("root"))).distinct()


def star_roots(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (node, root) for every node that isn't the smallest of its component; ``edges`` has node and root.

    Alternating stars: the number of rounds grows with the logarithm of the nodes. Each round is written to the
    shared folder, so a lost executor costs one round. Minima are pre-aggregated before they are shuffled, and the
    joins on a hub's key are plain joins, which adaptive execution splits when a key is hot. Null ends are dropped,
    loops and repeated edges are ignored; no edges give no rows.
    """
    edges = stored(
        edges.where("node IS NOT NULL AND root IS NOT NULL AND node != root")
        .select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            return edges
        edges = stored(_stars(edges), "edges")
        before, state = state, _state(edges)
        if state == before:
            return edges
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root")), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)"))).first())
