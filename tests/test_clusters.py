"""Spatial clusters: pairs left open by boxes, borders of tiles, long chains, and rows shuffled per place."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hexcadence.operators import clusters
from tests.test_edges import brute_clusters

EPS = 0.0005


def sizes(spark, pts):
    df = spark.createDataFrame(pts, "lat double, lon double")
    return sorted(r.n_members for r in clusters.spatial_clusters(df, "lat", "lon", EPS).collect())


def rows_shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def grid(n):
    """One place in the middle of every cell of n x n."""
    side = EPS / math.sqrt(2.0)
    return [((i + 0.5) * side, (j + 0.5) * side) for i in range(n) for j in range(n)]


def test_few_rows_are_shuffled_per_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond the threshold
    try:
        before = rows_shuffled(spark)
        assert sizes(spark, grid(60)) == [3600]
        moved = sum(n for k, n in rows_shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved / 3600 < 50


@pytest.mark.parametrize("seed", range(2))
def test_several_places_per_cell(spark, seed):
    """Dense blobs on both sides of zero, with gaps near eps between them."""
    rng = random.Random(seed)
    pts = []
    for i in range(12):
        lat, lon = rng.uniform(-0.012, 0.012), rng.uniform(-0.012, 0.012)
        pts += [(lat + rng.gauss(0, 0.0002 + i * 3e-5), lon + rng.gauss(0, 0.0003)) for _ in range(40)]
    assert sizes(spark, pts) == brute_clusters(pts, EPS)


@pytest.mark.parametrize("gap, expected", [(0.00049, [10]), (0.00051, [5, 5])])
def test_touch_between_inner_places(spark, gap, expected):
    """Two cells whose places nearest to each other are outermost in no direction."""
    ring = [(0.0, 0.0), (0.00002, -0.00003), (-0.00002, -0.00003), (0.0, -0.00006)]
    pts = [(1 + a, 1 + b) for a, b in ring] + [(1.00001, 0.99999)]
    pts += [(1 - a, 1 + gap - b) for a, b in ring] + [(0.99999, 1.00001 + gap)]
    assert sizes(spark, pts) == brute_clusters(pts, EPS) == expected


def test_chains_across_tiles(spark):
    step = 0.00049
    pts = [(i * step, 0.0) for i in range(-150, 150)]
    pts += [(0.03, 0.002 + i * step) for i in range(-150, 150)]
    pts += [(0.1 + i * step / 1.5, -0.1 + i * step / 1.5) for i in range(200)]
    assert sizes(spark, pts) == brute_clusters(pts, EPS)


def test_components_of_random_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(-5, k) for k in range(3000, 3400)]
    parent = {k: k for k in [-5, *range(3400)]}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[root(a)] = root(b)
    nodes = spark.createDataFrame([(k, -k) for k in parent], "node long, extra long")
    got = clusters.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(r.node for r in got) == sorted(parent) and all(r.extra == -r.node for r in got)
    pairs = {(r.root, root(r.node)) for r in got}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_coordinates_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    pts = [(0.0, 0.0), (0.0, -0.0001), (0.0004, 0.0)]
    odd = [(nan, 0.0), (0.0, nan), (inf, 0.0), (0.0, inf), (0.0, -inf), (None, 0.0), (0.0, None)]
    assert sizes(spark, pts + odd) == [3]
    df = spark.createDataFrame(pts, "lat double, lon double")
    only = clusters.spatial_clusters(df, "lat", "lon", EPS).select(F.col("cluster")).collect()
    assert len(only) == 1
