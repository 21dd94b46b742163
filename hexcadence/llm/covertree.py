"""All pairs of vectors within a cosine threshold, by dual traversal of cover trees.

On unit vectors, cosine >= t is Euclidean distance <= sqrt(2 - 2t), a metric that cover trees can prune. The top level
of the tree is a set of pivots; each row belongs to its nearest pivot's cell, and cells are dealt into blocks of bounded
size. A block holds a cover tree: nested levels whose radii halve, every node with the distance to its farthest row. Two
trees are traversed together: a pair of nodes is dropped if its rows are all too far apart, taken as a whole if they are
all near, and else replaced by the pairs of their children. Pairs that are taken whole are counted, never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcadence.llm.base import named, stored
from hexcadence.llm.components import local_roots, star_roots

BLOCK = 4096  #: rows of a tree
PIVOTS = 256  #: cells at most; pivots are a bounded sample that steers pruning, never the result
_FINEST = 1e-3  #: below this radius a node's children are its rows
_EPS = 1e-7  #: slack of the bounds, above the rounding of small distances; what they leave open is decided by the cosine
_DENSE = 1 << 21  #: node pairs measured at once
_WIDE = 32  #: partners from which on a node's are measured together


class Tree:
    """A cover tree over unit vectors: rows in tree order, nodes in breadth-first order with their children in a row."""

    FIELDS = ("center", "start", "end", "child", "children")

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.x, self.radius = vectors, radius
        self.center, self.start, self.end, self.child, self.children = nodes
        self.size = self.end - self.start
        self.centers = vectors[self.center].astype(np.float32)

    @staticmethod
    def build(unit: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and for each of its rows the number of the input row."""
        nodes: list[list] = []  # center row, start, end, child, children
        radius: list[float] = []
        order = np.zeros(len(unit), np.int64)
        place = np.zeros(len(unit), np.int64)
        todo: list[np.ndarray] = []
        scale: list[float] = []

        def add(rows: np.ndarray, center: int, start: int, level: float) -> None:
            far = np.sqrt(np.maximum(0.0, 2 - 2 * (unit[rows] @ unit[center]))).max() if len(rows) > 1 else 0.0
            nodes.append([center, start, start + len(rows), 0, 0])
            radius.append(float(far))
            todo.append(rows)
            scale.append(level)

        add(np.arange(len(unit)), 0, 0, 2.0)
        scale[0] = radius[0]  # the levels halve from the root's own radius
        at = 0
        while at < len(nodes):
            rows, level, start = todo[at], scale[at] / 2, nodes[at][1]
            todo[at] = None
            if len(rows) == 1:
                order[start], place[rows[0]] = rows[0], start
                at += 1
                continue
            while level >= max(_FINEST, radius[at]) and level > _FINEST:
                level /= 2  # a level at which the node would have one child, itself
            centers, owner = _cover(unit, rows, nodes[at][0], level) if level > _FINEST else (rows, np.arange(len(rows)))
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(len(centers) + 1))
            nodes[at][3], nodes[at][4] = len(nodes), len(centers)
            for c, a, b in zip(centers, cuts[:-1], cuts[1:], strict=True):
                add(rows[by[a:b]], int(c), start + int(a), level)
            at += 1
        table = np.array(nodes, np.int64).T.copy()
        table[0] = place[table[0]]
        return Tree(unit[order], table, np.array(radius)), order


def _cover(unit: np.ndarray, rows: np.ndarray, first: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Centers that lie more than ``level`` apart and cover the rows, the parent's own first; each row's nearest."""
    near = 1 - level * level / 2
    open_, centers = rows, []
    center = first
    while True:
        centers.append(center)
        open_ = open_[unit[open_] @ unit[center] < near]
        if not len(open_):
            break
        center = int(open_[0])
    picked = unit[centers]
    owner = np.empty(len(rows), np.int64)
    step = max(1, _DENSE // len(centers))
    for i in range(0, len(rows), step):
        owner[i : i + step] = (unit[rows[i : i + step]] @ picked.T).argmax(1)
    # A center owns itself, also among equal rows.
    where = np.argsort(rows, kind="stable")
    owner[where[np.searchsorted(rows[where], centers)]] = np.arange(len(centers))
    return np.array(centers), owner


def near_pairs(a: Tree, b: Tree | None, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Links of all rows of tree ``a`` with those of ``b`` (of ``a`` with itself if None), and their components.

    Gives the number of links of each row (of a, then of b), and edges as two arrays over rows and, beyond them, one
    hub per node that was taken as a whole.
    """
    own = b is None
    b = a if own else b
    na, nb = len(a.x), 0 if own else len(b.x)
    reach = np.sqrt(2 - 2 * threshold)
    change = np.zeros(na + nb + 1, np.int64)  # of the number of links, from row to row
    hub_a, hub_b = na + nb, na + nb + (0 if own else len(a.center))
    shift = 0 if own else na
    whole_i, whole_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, j = np.array([0]), np.array([0])
    while len(i):
        next_i, next_j = [i[:0]], [j[:0]]
        for ci, cj, cos in _children(a, b, i, j, own, reach + _EPS):
            far = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
            bound = a.radius[ci] + b.radius[cj]
            same = ci == cj if own else np.zeros(len(ci), bool)
            bound = np.where(same, 2 * a.radius[ci], bound)
            single = (a.size[ci] == 1) & (b.size[cj] == 1)
            maybe = np.where(single, cos >= threshold, far - bound <= reach + _EPS)
            whole = maybe & np.where(single, True, far + bound <= reach - _EPS)
            open_ = maybe & ~whole
            whole_i.append(ci[whole])
            whole_j.append(cj[whole])
            next_i.append(ci[open_])
            next_j.append(cj[open_])
        i, j = np.concatenate(next_i), np.concatenate(next_j)
    i, j = np.concatenate(whole_i), np.concatenate(whole_j)
    if own:
        same = (i == j) & (a.size[i] > 1)
        mixed = i != j
        np.add.at(change, a.start[i[same]], a.size[i[same]] - 1)
        np.add.at(change, a.end[i[same]], 1 - a.size[i[same]])
        keep = same | mixed
        i, j, mixed = i[keep], j[keep], mixed[keep]
    else:
        mixed = np.ones(len(i), bool)
    for x, y, tx, ty, off in ((i, j, a, b, 0), (j, i, b, a, shift)):
        np.add.at(change, tx.start[x[mixed]] + off, ty.size[y[mixed]])
        np.add.at(change, tx.end[x[mixed]] + off, -ty.size[y[mixed]])
    edges = [(i + hub_a, j + hub_b)]
    for x, t, hub, off in ((np.unique(i), a, hub_a, 0), (np.unique(j), b, hub_b, shift)):
        n = t.size[x]
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(t.start[x], n)
        edges.append((rows + off, np.repeat(x + hub, n)))
    return np.cumsum(change[:-1]), [np.concatenate(e) for e in zip(*edges, strict=True)]


def _children(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, own: bool, reach: float):
    """Pairs of children of node pairs, with the cosines of their centers; a node without children stands for itself."""
    fi, ni = np.where(a.children[i] > 0, a.child[i], i), np.maximum(1, a.children[i])
    fj, nj = np.where(b.children[j] > 0, b.child[j], j), np.maximum(1, b.children[j])
    cost = ni * nj
    for k in np.flatnonzero(cost > _DENSE // 8):
        rows, columns = np.arange(fi[k], fi[k] + ni[k]), np.arange(fj[k], fj[k] + nj[k])
        # Single rows have no radius: one limit for all of them. The others have their own.
        for one_row, one_column in ((True, True), (True, False), (False, True), (False, False)):
            part_rows = rows[(a.size[rows] == 1) == one_row]
            part_columns = columns[(b.size[columns] == 1) == one_column]
            for ci, cj, cos in _dense(a, b, part_rows, part_columns, reach, one_row and one_column):
                if own and i[k] == j[k]:
                    keep = ci <= cj
                    ci, cj, cos = ci[keep], cj[keep], cos[keep]
                yield ci, cj, cos
    rest = np.flatnonzero(cost <= _DENSE // 8)
    # A wide node meets many others at once: its children against all of theirs.
    for x, y, fx, nx, fy, ny, turned in ((i, j, fi, ni, fj, nj, False), (j, i, fj, nj, fi, ni, True)):
        rest = rest[np.argsort(x[rest], kind="stable")]
        _, at, times = np.unique(x[rest], return_index=True, return_counts=True)
        left = []
        for s, n in zip(at.tolist(), times.tolist(), strict=True):
            k = rest[s : s + n]
            mine = k[x[k] != y[k]] if own else k
            if len(mine) < _WIDE or nx[mine[0]] == 1:
                left.append(k)
                continue
            left.append(k[x[k] == y[k]] if own else k[:0])
            rows = np.arange(fx[mine[0]], fx[mine[0]] + nx[mine[0]])
            columns = _ranges(fy[mine], ny[mine])
            if turned:
                yield from _dense(a, b, columns, rows, reach, False)
            else:
                yield from _dense(a, b, rows, columns, reach, False)
        rest = np.concatenate(left) if left else rest
    ends = np.cumsum(cost[rest])
    s = 0
    while s < len(rest):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + _DENSE // 8, side="right")))
        k = rest[s:e]
        pair = np.repeat(k, cost[k])
        within = np.arange(len(pair)) - np.repeat(np.cumsum(cost[k]) - cost[k], cost[k])
        ci, cj = fi[pair] + within // nj[pair], fj[pair] + within % nj[pair]
        if own:
            keep = (i[pair] != j[pair]) | (ci <= cj)
            ci, cj = ci[keep], cj[keep]
        yield ci, cj, np.einsum("ij,ij->i", a.x[a.center[ci]], b.x[b.center[cj]])
        s = e


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for count[0] numbers, then the same for the others."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _dense(a: Tree, b: Tree, rows: np.ndarray, columns: np.ndarray, reach: float, single: bool):
    """Pairs of nodes within reach of each other: found in single precision with a margin, measured in double."""
    if not len(rows) or not len(columns):
        return
    right = b.centers[columns].T
    step = max(1, _DENSE // len(columns))
    for s in range(0, len(rows), step):
        part = rows[s : s + step]
        limit = reach if single else reach + a.radius[part][:, None] + b.radius[columns][None, :]
        r, c = np.nonzero(a.centers[part] @ right >= 1 - limit * limit / 2 - 1e-4)
        ci, cj = part[r], columns[c]
        for t in range(0, len(ci), _DENSE // 8):
            p, q = ci[t : t + _DENSE // 8], cj[t : t + _DENSE // 8]
            yield p, q, np.einsum("ij,ij->i", a.x[a.center[p]], b.x[b.center[q]])


# --- in Spark ---------------------------------------------------------------------------------------

_BLOCKS = "cell int, part int, n int, ids binary, vectors binary, nodes binary, radius binary"


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, over their largest component so that squares stay in range."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, dims: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assign(pivots: np.ndarray, dims: int):
    """Per batch: each row's nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = _unit(_matrix(batch.column(1), dims)) @ pivots.T
            cell = cos.argmax(1)
            far = np.sqrt(np.maximum(0.0, 2 - 2 * cos.max(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far)], names=["uid", "vec", "cell", "far"]
            )

    return run


def _plant(dims: int):
    def run(key, group):
        group = group.sort_by("uid")
        raw = _matrix(group["vec"], dims)
        tree, order = Tree.build(_unit(raw))
        nodes = np.array([tree.center, tree.start, tree.end, tree.child, tree.children], np.int64)
        ids = group["uid"].to_numpy()[order]
        return pa.table(
            {
                "cell": pa.array([key[0].as_py()], pa.int32()),
                "part": pa.array([key[1].as_py()], pa.int32()),
                "n": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([raw[order].tobytes()], pa.binary()),
                "nodes": pa.array([nodes.tobytes()], pa.binary()),
                "radius": pa.array([tree.radius.tobytes()], pa.binary()),
            }
        )

    return run


def _grown(row: dict, dtype: str) -> tuple[np.ndarray, Tree]:
    ids = np.frombuffer(row["ids"], "<i8")
    nodes = np.frombuffer(row["nodes"], np.int64).reshape(5, -1)
    unit = _unit(np.frombuffer(row["vectors"], dtype).reshape(len(ids), -1))
    return ids, Tree(unit, nodes, np.frombuffer(row["radius"]))


def _traverse(threshold: float, dtype: str):
    """Of one or two blocks: (uid, links found here, least uid of its component here) for rows that have links."""

    def run(group):
        rows = sorted(group.to_pylist(), key=lambda r: (r["cell"], r["part"]))
        ids, a = _grown(rows[0], dtype)
        b = None
        if len(rows) > 1:
            more, b = _grown(rows[1], dtype)
            ids = np.concatenate([ids, more])
        links, (u, v) = near_pairs(a, b, threshold)
        # Components over rows and hubs; a component's name is its least uid.
        node, root = local_roots(u, v)
        label = np.arange(max(len(ids), int(max(u.max(initial=0), v.max(initial=0))) + 1))
        label[node] = root
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, label[: len(ids)], ids)
        found = np.flatnonzero(links)
        return pa.table({"uid": ids[found], "links": links[found], "root": least[label[found]]})

    return run


def near_components(df: DataFrame, id_col: str, vector: str, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Rows (id, n_links, component_id, kept): exact links of all vectors with cosine >= threshold.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of
    different lengths. n_links counts the other rows that a row is linked with (repeated rows link each other),
    component_id is the smallest id reachable, kept tells whether that is the row's own. Only ``id_col`` and ``vector``
    are read. A pair of blocks is compared only if the bounds of their cells allow a link; where vectors fill the
    space evenly, as at random in many dimensions, no bound helps and all block pairs remain.
    """
    uid = "uid"
    floats = df.schema[vector].dataType.simpleString() == "array<float>"
    value = named(vector) if floats else named(vector).cast("array<double>")
    rows = stored(
        df.select(
            F.monotonically_increasing_id().alias(uid),
            named(id_col).alias("id"),
            F.when(usable(named(vector)), value).alias("vec"),
        ),
        "vectors",
    )
    lengths = [r["dims"] for r in rows.where("vec IS NOT NULL").select(F.size("vec").alias("dims")).distinct().toLocalIterator()]
    links = None
    for dims in lengths:
        found = _links(rows.where(F.size("vec") == dims).select(uid, "vec"), dims, threshold, block)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = stored(links, "links")
    counts = links.groupBy(uid).agg(F.sum("links").cast("bigint").alias("n_links"))
    roots = star_roots(links.select(F.col(uid).alias("node"), "root"))
    placed = stored(
        rows.select(uid, "id").join(roots, F.col(uid) == F.col("node"), "left")
        .select(uid, "id", F.coalesce("root", uid).alias("root"))
        .join(counts, uid, "left").select("id", "root", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "placed",
    )
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(least, "root").select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _links(rows: DataFrame, dims: int, threshold: float, block: int) -> DataFrame:
    n = rows.count()
    # Pivots: the rows with the smallest hashes, a bounded sample for the top level of the tree.
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(max(1, min(PIVOTS, -(-n // block)))).select("vec").toArrow()
    pivots = _unit(_matrix(sample["vec"], dims))
    kind = rows.schema["vec"].dataType.simpleString()
    dtype = "<f4" if kind == "array<float>" else "<f8"
    placed = stored(rows.mapInArrow(_assign(pivots, dims), f"uid bigint, vec {kind}, cell int, far double"), "cells")
    cells = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    parts = {c: -(-m // block) for c, (m, _) in cells.items()}
    n_parts = F.element_at(F.create_map(*[F.lit(x) for c in parts for x in (c, parts[c])]), F.col("cell"))
    trees = stored(
        placed.withColumn("part", F.pmod(F.xxhash64("uid"), n_parts).cast("int"))
        .groupBy("cell", "part").applyInArrow(_plant(dims), _BLOCKS),
        "trees",
    )
    # Cells (at most PIVOTS) whose rows may come near each other, with the other cell's number of blocks.
    reach = np.sqrt(2 - 2 * threshold) + _EPS
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
    pairs = [
        (a, b, parts[b]) for a in cells for b in cells if a == b or apart[a, b] <= reach + cells[a][1] + cells[b][1]
    ]
    table = rows.sparkSession.createDataFrame(pairs, "cell int, other int, parts int")
    me, it = F.struct("cell", "part"), F.struct(F.col("other").alias("cell"), F.col("with").alias("part"))
    met = (
        trees.join(F.broadcast(table), "cell")  # at most PIVOTS squared rows
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.least(me, it).alias("low"), F.greatest(me, it).alias("high"), "cell", "part", "n", "ids", "vectors", "nodes", "radius")
    )
    return met.groupBy("low", "high").applyInArrow(_traverse(threshold, dtype), "uid bigint, links bigint, root bigint")
