"""The static neighbourhood graph of active cells and what its neighbours say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcadence.functions.ranks import dense_index
from hexcadence.operators import geo
from hexcadence.operators.cube import active_cells

PROB_EPSILON = 1e-6


def node_index(counts: DataFrame, cell: str, value: str, min_events: int | None = 2) -> DataFrame:
    """Active cells with ids 0..n-1 in cell order."""
    if min_events is None:
        nodes = counts.where(F.col(cell).isNotNull()).select(cell).distinct()
    else:
        nodes = active_cells(counts.where(F.col(cell).isNotNull()), cell, value, min_events)
    return dense_index(nodes, [cell], "node_id")


def edges(nodes: DataFrame, cell: str, k: int = 1, self_loops: bool = True) -> DataFrame:
    """Directed edges (src, dst) between nodes within ``k`` steps, both directions.

    Rings are symmetric, so each direction arises from its own end; a self loop is given to nodes
    that have a neighbour.
    """
    near = geo.neighbours(nodes.select(F.col(cell).alias("_cell"), F.col("node_id").alias("src")), "_cell", k)
    targets = nodes.select(F.col(cell).alias("neighbour"), F.col("node_id").alias("dst"))
    pairs = near.join(targets, "neighbour").select("src", "dst")
    if not self_loops:
        return pairs
    loops = pairs.select("src").distinct().select("src", F.col("src").alias("dst"))
    return pairs.unionByName(loops)


def graph_info(nodes: DataFrame, edge_list: DataFrame) -> DataFrame:
    """Counts of nodes, connected and isolated nodes, and edges."""
    connected = edge_list.select("src").distinct()
    e = edge_list.agg(F.count(F.lit(1)).alias("n_edges"))
    c = connected.agg(F.count(F.lit(1)).alias("connected_nodes"))
    n, nc, ne = F.col("total_nodes"), F.col("connected_nodes"), F.col("n_edges")
    return (
        nodes.agg(F.count(F.lit(1)).alias("total_nodes"))
        .select("total_nodes", c.scalar().alias("connected_nodes"), e.scalar().alias("n_edges"))
        .select(
            "total_nodes",
            "connected_nodes",
            (n - nc).alias("isolated_nodes"),
            F.try_divide((n - nc) * F.lit(100.0), n).alias("isolated_percent"),
            "n_edges",
            F.try_divide(ne.cast("double"), n).alias("edges_per_node"),
        )
    )


def propagate(
    edge_list: DataFrame,
    features: DataFrame,
    bin_col: str,
    columns: Sequence[str],
    hops: int = 1,
    how: str = "mean",
) -> DataFrame:
    """Neighbour aggregate of node features per (node_id, bin), ``hops`` times.

    ``mean`` averages the sources of a node; ``sym`` is the sum weighted by
    ``1 / sqrt(deg(src) * deg(dst))``.  A node has at most 3k(k+1) + 1 sources, so no group is large.
    """
    e = edge_list.select("src", "dst")
    if how == "sym":
        degree = e.groupBy("dst").agg(F.count(F.lit(1)).cast("double").alias("_deg"))
        e = (
            e.join(degree.select(F.col("dst").alias("src"), F.col("_deg").alias("_ds")), "src")
            .join(degree.withColumnRenamed("_deg", "_dd"), "dst")
            .select("src", "dst", (1.0 / F.sqrt(F.col("_ds") * F.col("_dd"))).alias("_w"))
        )
    out = features.select(F.col("node_id"), bin_col, *columns)
    for _ in range(hops):
        joined = e.join(out.withColumnRenamed("node_id", "src"), "src")
        if how == "sym":
            aggs = [F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns]
        else:
            aggs = [F.avg(c).alias(c) for c in columns]
        out = joined.groupBy(F.col("dst").alias("node_id"), bin_col).agg(*aggs)
    return out.select("node_id", bin_col, *[F.col(c).alias(f"nb_{c}") for c in columns])


def baselines(snapshots: DataFrame, feature: str, bin_col: str) -> DataFrame:
    """Persistence, always 0, always 1 and the feature scaled by its maximum in the bin.

    Bin maxima are aggregated and joined back (a row per bin), not windowed over whole bins.  Rows
    without a bin are one bin.
    """
    peak = snapshots.groupBy(F.col(bin_col).alias("_bin")).agg(F.max(feature).alias("_max"))
    joined = snapshots.join(peak, F.col(bin_col).eqNullSafe(F.col("_bin"))).drop("_bin")
    scaled = F.col(feature) / (F.col("_max") + F.lit(PROB_EPSILON))
    return joined.withColumns(
        {
            "persistence": (F.col(feature) > 0).cast("int"),
            "always_zero": F.lit(0),
            "always_one": F.lit(1),
            "scaled_persistence": F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)),
        }
    ).drop("_max")


