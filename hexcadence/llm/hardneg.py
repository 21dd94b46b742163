"""Hard negatives by inner product windows: cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm: all then have norm M, and a large inner
product with a query means a small distance, which a cover tree can bound. The top level is a bounded sample of pivots;
their cells are dealt into blocks, and each block holds a tree whose nodes know their covering radius and the range of
their labels. A node with center c and radius r holds products between q.c - |q| r and q.c + |q| r. Descent opens the
nodes with the highest upper bound first, skips nodes outside every window or below the worst kept score, and checks
single rows by exact integer products.

In Spark, an anchor first visits the cells with the highest bounds; the scores it keeps there raise the lower ends of its
windows, and every later round visits several times as many cells, without those that the windows rule out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.llm.base import discard, named, small_batches, stored_at
from hexcadence.llm.covertree import Tree

BLOCK = 4096  #: rows of a tree
PIVOTS = 4096  #: cells at most; a bounded sample that steers pruning, never the result
CHUNK = 2048  #: anchors that visit a tree in one task, about
FIRST, MORE = 2, 8  #: cells of the first round, and how many times as many the next one visits
OPEN = 64  #: nodes that are opened at once
NO_ID = np.iinfo(np.int64).max
LEAST, MOST = -(1 << 62), 1 << 62

_WINDOWS = "array<struct<w:int, lo:bigint, hi:bigint>>"
_FOUND = "uid bigint, w int, score bigint, other bigint, cand bigint"


# --- in one tree --------------------------------------------------------------------------------


class Candidates:
    """A block of candidates: integer vectors in tree order, and what nodes know of them."""

    def __init__(self, tree: Tree, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, uids: np.ndarray, norm: float):
        self.tree, self.x, self.labels, self.ids, self.uids = tree, vectors, labels, ids, uids
        self.floats = vectors.astype(np.float64)
        self.spread = tree.radius * norm
        self.low, self.high = labels[tree.start].copy(), labels[tree.start].copy()
        for j in np.flatnonzero(tree.size > 1).tolist():
            own = labels[tree.start[j] : tree.end[j]]
            self.low[j], self.high[j] = own.min(), own.max()
        self.norm = norm

    def search(self, q: np.ndarray, uid: int, label: int, lows: Sequence[int], highs: Sequence[int], k: int, same: bool) -> list[tuple]:
        """Per window (low <= score <= high) its k best rows of the same or of different labels, the anchor left out.

        Gives (window, score, id, uid), higher scores first, ties by smaller id.
        """
        tree, size = self.tree, float(np.sqrt(float((q.astype(np.float64) ** 2).sum())))
        f = q.astype(np.float64)
        exact = size * self.norm < float(1 << 52)  # every partial sum is a whole number that a double holds
        lo, hi = list(lows), list(highs)
        kept: list[tuple] = [(np.zeros(0, np.int64),) * 2 for _ in lo]  # scores, rows
        nodes = np.zeros(1, np.int64)
        upper, lower = np.full(1, np.inf), np.full(1, -np.inf)
        while len(nodes):
            fits = np.zeros(len(nodes), bool)
            for a, b in zip(lo, hi, strict=True):
                fits |= (upper >= a) & (lower <= b)
            nodes, upper, lower = nodes[fits], upper[fits], lower[fits]
            if not len(nodes):
                break
            if len(nodes) > OPEN:  # best first
                order = np.argpartition(-upper, OPEN)
                now, later = order[:OPEN], order[OPEN:]
            else:
                now, later = np.arange(len(nodes)), np.zeros(0, np.int64)
            opened = nodes[now]
            nodes, upper, lower = nodes[later], upper[later], lower[later]
            n = np.maximum(1, tree.children[opened])
            below = np.where(tree.children[opened] > 0, tree.child[opened], opened)
            below = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(below, n)
            mine = (self.low[below] <= label) & (self.high[below] >= label)
            below = below[mine if same else (self.low[below] != label) | (self.high[below] != label)]
            single = tree.size[below] == 1
            rows = tree.start[below[single]]
            if len(rows):
                score = (self.floats[rows] @ f).astype(np.int64) if exact else self.x[rows] @ q
                good = (self.labels[rows] == label) == same
                good &= self.uids[rows] != uid
                rows, score = rows[good], score[good]
                for w, (a, b) in enumerate(zip(lo, hi, strict=True)):
                    inside = (score >= a) & (score <= b)
                    if inside.any():
                        s, r = np.concatenate([kept[w][0], score[inside]]), np.concatenate([kept[w][1], rows[inside]])
                        if len(s) > k:
                            best = np.lexsort((self.uids[r], self.ids[r], -s))[:k]
                            s, r = s[best], r[best]
                        kept[w] = (s, r)
                        if len(s) == k:
                            lo[w] = max(a, int(s.min()))
            wide = below[~single]
            if len(wide):
                middle = self.floats[tree.center[wide]] @ f
                # Slack above the rounding of floats; what it lets through is decided by integers.
                room = size * self.spread[wide] * (1 + 1e-9) + 1e-9 * (np.abs(middle) + size * self.spread.max()) + 1e-6
                nodes = np.concatenate([nodes, wide])
                upper, lower = np.concatenate([upper, middle + room]), np.concatenate([lower, middle - room])
        out = []
        for w, (s, r) in enumerate(kept):
            for i in np.lexsort((self.uids[r], self.ids[r], -s)):
                out.append((w, int(s[i]), int(self.ids[r[i]]), int(self.uids[r[i]])))
        return out


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Rows of norm 1: x / norm and what is missing to it. A norm of zero leaves the added component alone."""
    x = vectors.astype(np.float64) / (norm or 1.0)
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    out = np.concatenate([x, rest[:, None]], axis=1)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _matrix(column, dims: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.int64)


# --- in Spark -------------------------------------------------------------------------------------


def integers(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of every component; null where products could pass 2^56, which windows multiply by 100."""
    widest = int((2.0**56 / max(dims, 1)) ** 0.5)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < float(min(widest, 1 << 31) - 1))
    return F.when(fits, whole).cast("array<int>")


def _placed(pivots: np.ndarray, norm: float, dims: int):
    """Each row's nearest pivot and its distance in the augmented space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = augmented(_matrix(batch.column(3), dims), norm) @ pivots.T
            far = np.sqrt(np.maximum(0.0, 2 - 2 * cos.max(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cos.argmax(axis=1), pa.int32()), pa.array(far)], names=["uid", "id", "label", "vec", "cell", "far"]
            )

    return run


def _planted(norm: float, dims: int):
    """One tree of a block's rows, as a row of byte columns."""

    def run(key, group):
        group = group.sort_by("uid")
        vectors = _matrix(group["vec"], dims)
        tree, order = Tree.build(augmented(vectors, norm))
        nodes = np.array([tree.center, tree.start, tree.end, tree.child, tree.children], np.int64)
        columns = {"uids": group["uid"], "ids": group["id"], "labels": group["label"]}
        packed = {c: v.to_numpy()[order].astype("<i8").tobytes() for c, v in columns.items()}
        packed |= {"vectors": vectors[order].astype("<i4").tobytes(), "nodes": nodes.tobytes(), "radius": tree.radius.tobytes()}
        return pa.table(
            {"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32())}
            | {c: pa.array([v], pa.binary()) for c, v in packed.items()}
        )

    return run


_TREES = "cell int, part int, uids binary, ids binary, labels binary, vectors binary, nodes binary, radius binary"


def _grown(row: dict, norm: float, dims: int) -> Candidates:
    uids, ids, labels = (np.frombuffer(row[c], "<i8") for c in ("uids", "ids", "labels"))
    vectors = np.frombuffer(row["vectors"], "<i4").reshape(len(uids), dims).astype(np.int64)
    nodes = np.frombuffer(row["nodes"], np.int64).reshape(5, -1)
    # Bounds come from the integer centers; the tree's own vectors are not needed any more.
    tree = Tree(np.zeros((len(uids), 1)), nodes, np.frombuffer(row["radius"]))
    return Candidates(tree, vectors, labels, ids, uids, norm)


def _routed(cells: dict, pivots: np.ndarray, norm: float, dims: int, start: int, stop: int, same: bool):
    """Per anchor the cells at places start to stop in order of their upper bounds that its windows allow."""
    at = np.array(sorted(cells), np.int64)
    far, low, high = (np.array([cells[c][f] for c in at.tolist()]) for f in ("far", "low", "high"))
    centers = pivots[at, :dims] * norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(2), dims).astype(np.float64)
            label = batch.column(1).to_numpy()
            size = np.sqrt((q * q).sum(axis=1))
            middle = q @ centers.T
            room = size[:, None] * norm * far[None, :] * (1 + 1e-9) + 1e-9 * size[:, None] * norm + 1e-6
            upper, lower = middle + room, middle - room
            place = np.empty_like(upper, dtype=np.int64)
            np.put_along_axis(place, (-upper).argsort(axis=1, kind="stable"), np.arange(len(at))[None, :], axis=1)
            fits = np.zeros(upper.shape, bool)
            for i, windows in enumerate(batch.column(3).to_pylist()):
                for w in windows:
                    fits[i] |= (upper[i] >= w["lo"]) & (lower[i] <= w["hi"])
            mine = (low[None, :] <= label[:, None]) & (high[None, :] >= label[:, None])
            one = (low[None, :] == label[:, None]) & (high[None, :] == label[:, None])
            who, which = np.nonzero(fits & (place >= start) & (place < stop) & (mine if same else ~one))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(who)) for c in batch.columns], pa.array(at[which], pa.int32())], names=["uid", "label", "vec", "windows", "cell"]
            )

    return run


def _visited(norm: float, dims: int, k: int, same: bool):
    """Of one tree and the anchors that visit it: the best rows of every window."""

    def run(trees: pa.Table, anchors: pa.Table) -> pa.Table:
        columns: list[list[int]] = [[], [], [], [], []]
        if trees.num_rows and anchors.num_rows:
            block = _grown(trees.to_pylist()[0], norm, dims)
            vectors = _matrix(anchors["vec"], dims)
            asked = zip(anchors["uid"].to_pylist(), anchors["label"].to_pylist(), anchors["windows"].to_pylist(), vectors, strict=True)
            for uid, label, windows, q in asked:
                lows, highs = [w["lo"] for w in windows], [w["hi"] for w in windows]
                for w, score, other, cand in block.search(q, uid, label, lows, highs, k, same):
                    for c, v in zip(columns, (uid, windows[w]["w"], score, other, cand), strict=True):
                        c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["uid", "w", "score", "other", "cand"])

    return run


class Index:
    """Trees over all candidates of one number of components, in the shared folder."""

    def __init__(self, rows: DataFrame, dims: int, block: int = BLOCK):
        """``rows`` has uid, id (NO_ID for none), label and vec (integers)."""
        self.spark, self.dims = rows.sparkSession, dims
        square = F.aggregate("vec", F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint") * x.cast("bigint"))
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most")).first()
        self.n, self.norm = first["n"], float(first["most"] or 0) ** 0.5
        sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(max(1, min(PIVOTS, -(-self.n // block)))).select("vec").toArrow()
        self.pivots = augmented(_matrix(sample["vec"], dims), self.norm)
        placed, path = stored_at(
            rows.select("uid", "id", "label", "vec")
            .mapInArrow(_placed(self.pivots, self.norm, dims), "uid bigint, id bigint, label bigint, vec array<int>, cell int, far double"),
            "cells",
        )
        # At most PIVOTS rows.
        told = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min("label").alias("low"), F.max("label").alias("high")
        )
        self.cells = {r["cell"]: r.asDict() for r in told.collect()}
        parts = self.spark.createDataFrame([(c, -(-v["n"] // block)) for c, v in self.cells.items()], "cell int, parts int")
        self.parts = F.broadcast(parts)
        self.trees, self.path = stored_at(
            placed.join(self.parts, "cell")
            .withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
            .groupBy("cell", "part").applyInArrow(_planted(self.norm, dims), _TREES),
            "trees",
        )
        discard(self.spark, path)

    def best(self, anchors: DataFrame, k: int, same: bool, chunk: int = CHUNK) -> DataFrame:
        """Per anchor and window its k best candidates of the same or of different labels: (uid, w, score, other, cand).

        ``anchors`` has uid, label, vec and windows. The rounds are few (their visits grow eightfold), and each is
        written to the shared folder.
        """
        n_chunks = max(1, -(-anchors.count() // chunk))
        found, path = None, None
        start, stop = 0, FIRST
        while start < len(self.cells):
            asked = anchors
            if found is not None:
                # A full window needs no score below its worst one.
                full = found.groupBy("uid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
                floors = full.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("floors"))
                raised = F.transform(
                    "windows",
                    lambda x: F.struct(x["w"].alias("w"), F.greatest(x["lo"], F.try_element_at(F.col("floors"), x["w"])).alias("lo"), x["hi"].alias("hi")),
                )
                asked = anchors.join(floors, "uid", "left").withColumn("windows", F.when(F.col("floors").isNull(), F.col("windows")).otherwise(raised))
            asked = asked.select("uid", "label", "vec", "windows")
            visits = asked.mapInArrow(
                _routed(self.cells, self.pivots, self.norm, self.dims, start, stop, same), f"uid bigint, label bigint, vec array<int>, windows {_WINDOWS}, cell int"
            )
            visits = visits.join(self.parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            visits, visits_path = stored_at(visits.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(n_chunks)).cast("int")), "visits")
            needed = visits.select(*[F.col(c).alias(c) for c in ("cell", "part", "chunk")]).distinct()
            keys = ["cell", "part", "chunk"]
            new = (
                self.trees.join(needed, ["cell", "part"]).groupBy(*keys)
                .cogroup(visits.groupBy(*keys)).applyInArrow(_visited(self.norm, self.dims, k, same), _FOUND)
            )
            both = new if found is None else found.unionByName(new)
            # A window has at most k rows from each tree that it visits.
            order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "other", "cand")
            ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
            before, (found, written) = path, stored_at(ranked, "found")
            for old in (visits_path, before):
                if old:
                    discard(self.spark, old)
            path = written
            start, stop = stop, stop * MORE
        return found


def mine(
    df: DataFrame, id_col: str, label: str, vector: str, anchor: Column, *, scale: int = 256, n_positives: int = 5, n_negatives: int = 10,
    low: int = 30, high: int = 90, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Components become floor(scale * x); a score is the inner product of two such vectors. Positives of an anchor are its
    ``n_positives`` best other rows of its label, negatives of a positive the ``n_negatives`` best rows of other labels
    whose score lies between ``low`` and ``high`` percent of the positive's. Higher scores come first, ties by smaller id;
    rows without an id follow all others, repeated rows count as often as they occur.
    Rows with a null label, a null vector, or a null or non-finite component take no part; neither do vectors whose
    products could pass 2^56 (a component of about 30 million at 64 components), which longs could not compare. Vectors
    of different lengths have no product. ``anchor`` is a condition on the columns of ``df``; without anchors, or on an
    empty table, there are no rows. Columns of other names are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    v = named(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = df.where(named(label).isNotNull() & v.isNotNull() & good).select(
        F.coalesce(named(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), named(id_col).isNull().alias("no_id"),
        named(label).cast("bigint").alias("label"), v.alias("raw"), F.coalesce(anchor, F.lit(False)).alias("asks"),
    )
    # Rows without an id have a negative number.
    number = F.monotonically_increasing_id()
    rows, path = stored_at(usable.withColumn("uid", F.when(F.col("no_id"), -1 - number).otherwise(number)).drop("no_id"), "rows")
    lengths = [r["n"] for r in rows.where("asks").select(F.size("raw").alias("n")).distinct().collect()]
    found = None
    for dims in lengths:
        part = rows.where(F.size("raw") == dims).withColumn("vec", integers(F.col("raw"), scale, dims)).where("vec IS NOT NULL").drop("raw")
        some = _mined(part, dims, n_positives, n_negatives, low, high, block, chunk)
        found = some if found is None else found.unionByName(some)
    if found is None:
        schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        found = spark.createDataFrame([], schema)
    return found


def _mined(rows: DataFrame, dims: int, n_positives: int, n_negatives: int, low: int, high: int, block: int, chunk: int) -> DataFrame:
    index = Index(rows.select("uid", "id", "label", "vec"), dims, block)
    asking = rows.where("asks").select("uid", "id", "label", "vec")
    everything = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    near = index.best(asking.withColumn("windows", everything.cast(_WINDOWS)), n_positives, True, chunk)
    if near is None:
        near = rows.sparkSession.createDataFrame([], _FOUND)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "other", "cand")
    positives = near.select(
        "uid", F.row_number().over(order).alias("w"), F.col("score").alias("positive_score"), _id("other", "cand").alias("positive_id")
    )
    # Whole numbers between low and high percent: ceil and floor in integers.
    s = F.col("positive_score")
    lo, hi = -_hundredth(-low * s), _hundredth(high * s)
    window = F.struct(F.col("w").cast("int").alias("w"), lo.alias("lo"), hi.alias("hi"))
    windows = positives.where(lo <= hi).groupBy("uid").agg(F.collect_list(window).alias("windows"))
    chosen = index.best(asking.join(windows, "uid"), n_negatives, False, chunk)
    if chosen is None:
        chosen = rows.sparkSession.createDataFrame([], _FOUND)
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "other", "cand")
    ranked = chosen.select("uid", "w", F.row_number().over(order).alias("rank"), _id("other", "cand").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        asking.select("uid", F.col("id").alias("anchor_id")).join(positives, "uid").join(ranked, ["uid", "w"])
        .select("anchor_id", "positive_id", "rank", "negative_id", s.alias("positive_score"), "negative_score")
    )


def _hundredth(whole: Column) -> Column:
    """floor(whole / 100) in integers."""
    return F.floor((whole - F.pmod(whole, F.lit(100))) / F.lit(100).cast("decimal(3,0)")).cast("bigint")


def _id(number: str, uid: str) -> Column:
    return F.when(F.col(uid) >= 0, F.col(number))
