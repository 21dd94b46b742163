"""k-means by Shallot search against plain Lloyd rounds in Python integers."""

import hashlib
import random

import numpy as np
import pytest

from hexcadence.llm import shallot
from hexcadence.llm.workload import op11_shallot

SF = "/root/testdata/sf0.01"


def plain(rows, dims, scale, k, rounds, prefix):
    """rows: (id, vector); every distance of every round, in Python integers."""
    import math

    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"{prefix}{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centroids = [
            [sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == j], strict=True)] if j in own else c
            for j, c in enumerate(centroids)
        ]
    last = [nearest(v) for _, v in kept]
    inertia = {j: sum(d for d, o in last if o == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, last, strict=True)]


def key(r):
    return tuple((x is not None, x) for x in r)


def test_query_equals_plain_rounds(spark):
    got = op11_shallot(spark, SF)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 64, 1024, 8, 10, "3:"))


@pytest.mark.parametrize(("k", "spread"), [(1, 1.0), (2, 0.2), (7, 0.02), (30, 0.3), (60, 1.0)])
def test_clusters_ties_and_hard_rows(spark, k, spread):
    r = random.Random(k)
    centers = [[r.uniform(-1, 1) for _ in range(3)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, spread) for x in r.choice(centers)]) for i in range(200)]
    rows += [(1000 + i, [float(i % 3), 0.0, float(i % 2)]) for i in range(40)]  # ties and repeated vectors
    rows += rows[:20]  # repeated rows
    rows += [(None, [0.1, 0.2, 0.3]), (1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0, 0) for i, v in rows], "id bigint, v array<double>, vec string, `distance` double, first int").repartition(5)
    got = shallot.cluster(df, "id", "v", dims=3, scale=16, k=k, rounds=6, prefix="a")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, 3, 16, k, 6, "a"), key=key)


def test_no_rounds_empty_and_wide(spark):
    schema = "id bigint, v array<double>"
    rows = [(i, [float(i % 5)]) for i in range(20)]
    df = spark.createDataFrame(rows, schema)
    got = shallot.cluster(df, "id", "v", dims=1, scale=4, k=3, rounds=0, prefix="")
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 1, 4, 3, 0, ""))
    assert shallot.cluster(df.limit(0), "id", "v", dims=1, scale=4, k=3, rounds=2, prefix="").collect() == []
    wide = spark.createDataFrame([*rows, (99, [1e300]), (98, [-1e9])], schema)
    got = {r["id"]: tuple(r)[1:] for r in shallot.cluster(wide, "id", "v", dims=1, scale=4, k=3, rounds=2, prefix="").collect()}
    assert got[99] == got[98] == (None,) * 5
    assert sorted((i, *v) for i, v in got.items() if i < 90) == sorted(plain(rows, 1, 4, 3, 2, ""))


def test_bounds_spare_measurements(monkeypatch):
    """Vectors near a centroid that hardly moves are not searched again."""
    r = np.random.default_rng(3)
    centers = r.integers(-900, 900, (12, 8))
    x = np.repeat(centers, 50, axis=0) + r.integers(-5, 6, (600, 8))
    search = shallot.Search(centers)
    state = search.assign(x, *search.start(len(x)))
    asked = []
    one = shallot.Search._search
    monkeypatch.setattr(shallot.Search, "_search", lambda self, y, *a: asked.append(len(y)) or one(self, y, *a))
    moved = centers + r.integers(-2, 3, centers.shape)
    state = shallot.Search(moved, centers).assign(x, *state)
    assert sum(asked) == 0
    want = ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)
    assert (state[0] == want).all()
