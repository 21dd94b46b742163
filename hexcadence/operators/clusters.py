"""Spatial clusters: connected components of points that lie within ``eps`` of each other.

This is density clustering with two points as the minimum.  Equal coordinates collapse first, so a
hot place is one row.  Points are then bound to square cells with diagonal ``eps``: all points of
a cell belong together, and only the question whether two nearby cells touch is open.  It is
answered by bounding boxes and their outermost points.  The few pairs that these leave open are
split until every pair of boxes is decided - exact, without writing out pairs of points.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.session import materialise, scratch_path

_REACH = 2  # cells further away on an axis hold no point within eps
_TILE_BITS = 5  # tiles of 32 x 32 cells: with their borders at most 34 x 36 rows
_COLUMN = 64  # step of a tile's order from one column of cells to the next
_HALVINGS = 2
_MAX_LEVELS = 26  # 52 halvings: the digits of a double


def _cell_id(gx: Column, gy: Column) -> Column:
    """A cell's id packs its two coordinates, which stay below 2^31 for degrees and any sensible eps."""
    return F.shiftleft(gx, 32) + gy


def _cell_y(cell: Column) -> Column:
    return F.shiftright(F.shiftleft(cell, 32), 32)


def _cell_x(cell: Column) -> Column:
    return F.shiftright(cell - _cell_y(cell), 32)


def _bound(places: DataFrame, eps: float) -> DataFrame:
    """Places with their cell and their place inside it (fx, fy in [0, 1))."""
    side = eps / math.sqrt(2.0) * (1 - 1e-12)
    gx, gy = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    inside = [
        F.least(F.greatest(F.col(c) / F.lit(side) - g, F.lit(0.0)), F.lit(1 - 2.0**-53))
        for c, g in (("x", gx), ("y", gy))
    ]
    return places.withColumns({"cell": _cell_id(gx, gy), "fx": inside[0], "fy": inside[1]})


def _box() -> list[Column]:
    """Tight bounding box of some places, a place on each of its sides, and their number."""
    return [
        F.count(F.lit(1)).alias("n_places"),
        *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))],
        *[f("y", "x").alias(f"y_at_x{i}") for i, f in enumerate((F.min_by, F.max_by))],
        *[f("x", "y").alias(f"x_at_y{i}") for i, f in enumerate((F.min_by, F.max_by))],
    ]


def _side(boxes: DataFrame, s: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{s}_{c}") for c in boxes.columns])


def _near2() -> Column:
    """Squared distance of the two boxes of a pair."""
    dx = F.greatest(F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"), F.lit(0.0))
    dy = F.greatest(F.col("a_y0") - F.col("b_y1"), F.col("b_y0") - F.col("a_y1"), F.lit(0.0))
    return dx * dx + dy * dy


def _far2() -> Column:
    """Largest squared distance between points of the two boxes."""
    dx = F.greatest(F.col("a_x1") - F.col("b_x0"), F.col("b_x1") - F.col("a_x0"))
    dy = F.greatest(F.col("a_y1") - F.col("b_y0"), F.col("b_y1") - F.col("a_y0"))
    return dx * dx + dy * dy


def _outermost(s: str) -> list[tuple[Column, Column]]:
    """The places on the four sides of a box; they are all its places where it has two at most."""
    return [(F.col(f"{s}_x{i}"), F.col(f"{s}_y_at_x{i}")) for i in (0, 1)] + [
        (F.col(f"{s}_x_at_y{i}"), F.col(f"{s}_y{i}")) for i in (0, 1)
    ]


def _judged(pairs: DataFrame, limit: Column, *keys: str) -> DataFrame:
    """Pairs of boxes that touch (``sure``) or may touch, without those that surely do not."""
    seen = reduce(
        or_,
        [
            (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= limit
            for ax, ay in _outermost("a")
            for bx, by in _outermost("b")
        ],
    )
    told = pairs.where(_near2() <= limit).select(
        *keys,
        ((_far2() <= limit) | seen).alias("sure"),
        ((F.col("a_n_places") > 2) | (F.col("b_n_places") > 2)).alias("_inner"),
    )
    return told.where(F.col("sure") | F.col("_inner")).drop("_inner")


def _neighbours(cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of cells that can hold points within eps, each pair once.

    Every cell goes to its tile and to the tiles whose border it is.  There its neighbours are a
    few ranges of the order by column and row, so cells are shuffled once and not per neighbour.
    """
    x, y = _cell_x(F.col("cell")), _cell_y(F.col("cell"))
    box = [c for c in cells.columns if c != "n_rows"]
    side = 2**_TILE_BITS

    def tile(c: Column) -> Column:
        return F.shiftright(c, _TILE_BITS)

    tiled = cells.select(*box, F.explode(F.sequence(tile(x - _REACH), tile(x))).alias("_tx"))
    tiled = tiled.select("*", F.explode(F.sequence(tile(y - _REACH), tile(y + _REACH))).alias("_ty"))
    at = (x - F.col("_tx") * side) * _COLUMN + (y - F.col("_ty") * side + _REACH)
    order = Window.partitionBy("_tx", "_ty").orderBy("_at")
    # Half of the neighbours (the other half is found from the other side).
    ranges = [(dx * _COLUMN + (-_REACH if dx else 1), dx * _COLUMN + _REACH) for dx in range(_REACH + 1)]
    beside = [F.collect_list(F.struct(*box)).over(order.rangeBetween(*r)) for r in ranges]
    found = tiled.withColumn("_at", at).select("*", F.concat(*beside).alias("_b"))
    home = found.where((tile(x) == F.col("_tx")) & (tile(y) == F.col("_ty")))
    pairs = home.select(*[F.col(c).alias(f"a_{c}") for c in box], F.explode("_b").alias("_b"))
    return pairs.select("*", *[F.col(f"_b.{c}").alias(f"b_{c}") for c in box]).drop("_b")


def touching_cells(cells: DataFrame, places: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of cells that hold two points within ``eps``.

    ``places``: distinct x, y; ``cells``: their cells, each with the box of its places.
    """
    limit = F.lit(eps * eps)
    pair = ["a_cell", "b_cell"]
    sub = [f"{s}_{c}" for s in "ab" for c in ("sx", "sy")]
    judged = materialise(_judged(_neighbours(cells), limit, *pair))
    judged = judged.withColumns({c: F.lit(0).cast("long") for c in sub})
    points = _bound(places, eps).drop("n")
    edges = None
    for level in range(1, _MAX_LEVELS + 1):
        found = judged.where("sure").select(*pair)
        if edges is not None:
            found = found.distinct()
        edges = found if edges is None else edges.unionByName(found)
        open_pairs = judged.where(~F.col("sure"))
        if level > 1:
            open_pairs = open_pairs.join(found, pair, "left_anti")
        open_pairs = materialise(open_pairs.drop("sure"))
        if open_pairs.isEmpty():
            return edges.toDF("a", "b")
        # Split both boxes of every open pair (4 x 4 parts) and look again, at their cells alone.
        left = open_pairs.select(F.explode(F.array(*pair)).alias("cell")).distinct()
        points = materialise(points.join(left, "cell", "left_semi"))
        parts = float(2 ** (_HALVINGS * level))
        fine = points.groupBy(
            "cell", F.floor(F.col("fx") * parts).alias("sx"), F.floor(F.col("fy") * parts).alias("sy")
        ).agg(*_box())
        fine = materialise(fine)

        def children(s: str) -> DataFrame:
            kids = _side(fine, s)
            return kids.withColumns({f"_{s}{c}": F.shiftright(f"{s}_s{c}", _HALVINGS) for c in "xy"})

        keys = open_pairs.select(*pair, *[F.col(f"{s}_s{c}").alias(f"_{s}{c}") for s in "ab" for c in "xy"])
        pairs = keys.join(children("a"), ["a_cell", "_ax", "_ay"]).join(children("b"), ["b_cell", "_bx", "_by"])
        judged = materialise(_judged(pairs, limit, *pair, *sub))
    raise RuntimeError(f"boxes are still undecided after {_MAX_LEVELS} levels: eps is too small for the coordinates")


def _mixed(node: Column) -> Column:
    """Another number for each 64-bit number, in no order that a map could follow."""
    half = F.lit(2**32 - 1)
    node = node.bitwiseXOR(F.shiftleft(F.hash(node.bitwiseAND(half)).cast("long"), 32))
    return node.bitwiseXOR(F.hash(F.shiftrightunsigned(node, 32)).cast("long").bitwiseAND(half))


def _stored(df: DataFrame) -> DataFrame:
    """Rows kept as files: unlike a checkpoint they have a known size, where estimates would multiply with every round."""
    path = scratch_path(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``nodes`` (any columns, a long ``node``) with ``root``: the same number for all nodes of a component.

    Every round merges each node with the least node two steps away, in an order that is mixed anew
    so that long chains break into short ones.  Only the edges between merged nodes go on, a
    fraction of those before; the rounds are put together from the last to the first.
    """
    links = edges.select("a", "b")
    steps = []
    for _ in range(max_rounds):
        links = _stored(links.select(_mixed(F.col("a")).alias("a"), _mixed(F.col("b")).alias("b")))
        if links.isEmpty():
            break
        both = links.toDF("u", "v").unionByName(links.toDF("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        step = _stored(least.join(least.toDF("p", "to"), "p").select("u", "to"))
        steps.append(step)
        links = links.join(step.toDF("a", "c"), "a").join(step.toDF("b", "d"), "b").where("c != d")
        links = links.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
    else:
        raise RuntimeError("components did not settle")

    def ends(left: DataFrame, key: Column, table: DataFrame) -> DataFrame:
        joined = left.withColumn("_key", key).join(table.toDF("_key", "_root"), "_key", "left")
        return joined.withColumn("root", F.coalesce("_root", "_key")).drop("_key", "_root")

    if not steps:
        return nodes.withColumn("root", _mixed(F.col("node")))
    table = steps.pop()
    while steps:
        table = ends(steps.pop(), _mixed(F.col("to")), table).select("u", "root")
    return ends(nodes, _mixed(F.col("node")), table)


def spatial_clusters(df: DataFrame, lat: str, lon: str, eps: float = 0.0005) -> DataFrame:
    """One row per cluster of at least two rows: its extent, distinct places and rows.

    Rows whose coordinates are null or not finite lie within ``eps`` of nothing and take no part.
    """
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    placed = df.where((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    places = materialise(placed.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n")))
    cells = materialise(_bound(places, eps).groupBy("cell").agg(F.sum("n").alias("n_rows"), *_box()))
    extents = cells.select(F.col("cell").alias("node"), "n_rows", "n_places", "x0", "x1", "y0", "y1")
    return (
        components(extents, touching_cells(cells, places, eps))
        .groupBy("root")
        .agg(
            F.min("node").alias("cluster"),
            F.sum("n_rows").alias("n_members"),
            F.sum("n_places").alias("n_places"),
            F.min("y0").alias("min_lat"),
            F.max("y1").alias("max_lat"),
            F.min("x0").alias("min_lon"),
            F.max("x1").alias("max_lon"),
        )
        .where(F.col("n_members") >= 2)
        .drop("root")
    )


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum("n_members"), F.lit(0)).alias("n_members")
    )
