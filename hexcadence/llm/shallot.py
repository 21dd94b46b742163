"""Exact k-means over integer vectors by Shallot search.

Every vector remembers its centroid, the second-nearest one it has seen, an upper bound of the distance to the first and
a lower bound of the distance to all others. Moved centroids loosen the bounds by how far they moved; a vector whose
bounds still hold is not measured. For the others the two remembered centroids are measured, and the search starts from
the closer one: its neighbours are tried in order of their distance to it, inside a ball whose radius is the vector's
distance to that centroid plus its distance to the second best so far. The ball shrinks whenever a closer second is
found. Bounds only exclude; all that they leave is compared in integers, ties going to the smaller number.

A round is one pass that reads the vectors and writes them with their new bounds, and with one row of sums per task and
centroid; new centroids come from those rows alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcadence.llm.base import discard, named, small_batches, stored_at

#: Components beyond this could not be squared and summed in a long.
WIDEST = 1 << 27
_ROWS = 1 << 13  #: vectors measured at once
_STATE = "vec array<int>, first int, second int, upper double, lower double, n bigint, sums array<bigint>"


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as long; null where one doesn't fit."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < float(WIDEST))
    return F.when(fits, whole)


def finite(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none of them null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & good, F.lit(False))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """One round's centroids: how far each moved, and for each the others by distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, self.k = centroids, len(centroids)
        moved = np.zeros(self.k) if before is None else np.sqrt(_squares(centroids, before).astype(np.float64))
        self.moved = moved
        # The largest move among all but oneself.
        most = int(moved.argmax())
        self.others = np.full(self.k, moved[most])
        self.others[most] = np.delete(moved, most).max(initial=0.0)
        # Sorted row by row; k squared numbers, k is a parameter.
        apart = np.empty((self.k, self.k))
        for j in range(self.k):
            apart[j] = np.sqrt(_squares(centroids, centroids[j]).astype(np.float64))
            apart[j, j] = -1.0
        self.near = apart.argsort(axis=1, kind="stable")[:, 1:]
        self.gap = np.take_along_axis(apart, self.near, axis=1)

    def start(self, n: int) -> tuple[np.ndarray, ...]:
        """The state of vectors that know nothing yet."""
        second = 1 if self.k > 1 else 0
        return np.zeros(n, np.int32), np.full(n, second, np.int32), np.full(n, np.inf), np.full(n, -np.inf)

    def assign(self, x: np.ndarray, first, second, upper, lower) -> tuple[np.ndarray, ...]:
        """New (first, second, upper, lower) of vectors, by bounds where they decide and by search elsewhere."""
        first, second = first.copy(), second.copy()
        upper = upper + self.moved[first]
        lower = lower - self.others[first]
        if self.k == 1:
            return first, second, upper, lower
        # Bounds are sums of a few roots: their rounding is far below this slack.
        todo = np.flatnonzero(~(upper * (1 + 1e-9) + 1e-6 < lower))
        if len(todo):
            first[todo], second[todo], upper[todo], lower[todo] = self._search(x[todo], first[todo], second[todo])
        return first, second, upper, lower

    def _search(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        da, db = _squares(x, self.c[a]), _squares(x, self.c[b])
        swap = (db < da) | ((db == da) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        da, db = np.where(swap, db, da), np.where(swap, da, db)
        center, reach = a.copy(), np.sqrt(da.astype(np.float64))
        other = b.copy()
        open_ = np.arange(len(x))
        for place in range(self.k - 1):
            ball = reach[open_] + np.sqrt(db[open_].astype(np.float64))
            # Sorted neighbours: beyond the ball's edge all others are beyond it too.
            open_ = open_[self.gap[center[open_], place] <= ball * (1 + 1e-9) + 1e-6]
            if not len(open_):
                break
            c = self.near[center[open_], place]
            fresh = c != other[open_]
            rows, c = open_[fresh], c[fresh]
            d = _squares(x[rows], self.c[c])
            best = (d < da[rows]) | ((d == da[rows]) & (c < a[rows]))
            next_ = ~best & ((d < db[rows]) | ((d == db[rows]) & (c < b[rows])))
            r, s = rows[best], rows[next_]
            b[r], db[r] = a[r], da[r]
            a[r], da[r] = c[best], d[best]
            b[s], db[s] = c[next_], d[next_]
        return a, b, np.sqrt(da.astype(np.float64)), np.sqrt(db.astype(np.float64))


def _round(search: Search, dims: int, first_round: bool):
    """Vectors with their new state; after them one row of sums for every centroid that this task has vectors of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((search.k, dims), np.int64), np.zeros(search.k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                part = whole.slice(at, _ROWS)
                n = part.num_rows
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.int64)
                state = search.start(n) if first_round else [part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
                state = search.assign(x, *state)
                np.add.at(sums, state[0], x)
                counts += np.bincount(state[0], minlength=search.k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *map(pa.array, state), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                    names=["id", "vec", "first", "second", "upper", "lower", "n", "sums"],
                )
        own = np.flatnonzero(counts)
        none = [pa.nulls(len(own), t) for t in (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [none[0], none[1], pa.array(own, pa.int32()), none[2], none[3], none[4], pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))],
            names=["id", "vec", "first", "second", "upper", "lower", "n", "sums"],
        )

    return run


def _moved(totals: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means; a centroid without vectors stays. k times dims sums reach the driver."""
    wide = totals.select("first", "n", F.posexplode("sums").alias("at", "x"))
    found = wide.groupBy("first", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = centroids.copy()
    for r in found.collect():
        out[r["first"], r["at"]] = int(r["x"]) // int(r["n"])
    return out


def _measured(search: Search, dims: int):
    """(id, cluster, distance): the last assignment, with the exact distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                part = whole.slice(at, _ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims).astype(np.int64)
                first = search.assign(x, *[part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)])[0]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(first, pa.int32()), pa.array(_squares(x, search.c[first]))], names=["id", "cluster", "distance"]
                )

    return run


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256 after ``prefix`` (a null id counts as no digits).

    Rows of one id follow each other by their components. Fewer rows give fewer centroids.
    """
    digest = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["vec"] for r in vectors.select(digest.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()], np.int64)


def cluster(df: DataFrame, id_col: str, vector: str, *, dims: int, scale: int, k: int, rounds: int, prefix: str) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    A vector is usable if it has ``dims`` components, none of them null or non-finite; others have no row. Components
    become floor(scale * x). ``rounds`` times all vectors are assigned and the centroids replaced by the floors of their
    means; one assignment follows. Distances are squared; inertia sums them, as long (null beyond it).
    A usable vector with a component of 2^27 or more after scaling has no distance that fits a long: it takes no part and
    comes back with null in every column but its id. Repeated rows count as often as they occur; equal centroids are
    told apart by their numbers, so that the later one stays empty. Fewer than k vectors give as many centroids; an
    empty table gives no rows. Only ``id_col`` (a long) and ``vector`` are read, whatever other columns are called.
    """
    spark = df.sparkSession
    rows = df.where(finite(named(vector), dims)).select(named(id_col).cast("bigint").alias("id"), integers(named(vector), scale).cast("array<int>").alias("vec"))
    fitting = rows.where("vec IS NOT NULL")
    small_batches(spark)
    state, path = stored_at(fitting, "vectors")
    centroids = first_centroids(state, k, prefix)
    if len(centroids) == 0:
        return _with_totals(rows.where("vec IS NULL").select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance")), centroids, spark)
    before = None
    for number in range(rounds):
        search = Search(centroids, before)
        again, written = stored_at(state.mapInArrow(_round(search, dims, number == 0), f"id bigint, {_STATE}"), "round")
        discard(spark, path)
        path = written
        before, centroids = centroids, _moved(again.where("sums IS NOT NULL"), centroids)
        state = again.where("sums IS NULL").drop("n", "sums")
    if rounds == 0:
        start = Search(centroids).start(1)
        state = state.select("id", "vec", *[F.lit(v[0].item()).cast(t).alias(c) for v, t, c in zip(start, ("int", "int", "double", "double"), ("first", "second", "upper", "lower"), strict=True)])
    last, _ = stored_at(state.mapInArrow(_measured(Search(centroids, before), dims), "id bigint, cluster int, distance bigint"), "clusters")
    discard(spark, path)
    too_wide = rows.where("vec IS NULL").select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
    return _with_totals(last.unionByName(too_wide), centroids, spark)


def _with_totals(rows: DataFrame, centroids: np.ndarray, spark: SparkSession) -> DataFrame:
    """Inertias from one aggregate with a row per centroid, digests from the centroids; both k rows, broadcast."""
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = rows.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    sums = per.withColumn("all", per.agg(F.sum("own").alias("all")).scalar())
    table = names.join(sums, "cluster", "left").select("cluster", "centroid_sha256", F.expr("try_cast(own AS bigint)").alias("cluster_inertia"), F.expr("try_cast(all AS bigint)").alias("inertia"))
    return rows.join(F.broadcast(table), "cluster", "left").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
