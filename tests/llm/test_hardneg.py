"""Hard negatives against all products in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexcadence.llm import hardneg
from hexcadence.llm.covertree import Tree
from hexcadence.llm.workload import op12_hard_negatives

NO_ID = hardneg.NO_ID


def plain(rows, asks, scale=256, n_positives=5, n_negatives=10, low=30, high=90):
    """rows: (id, label, vector)."""
    kept = [
        (NO_ID if i is None else i, i, lab, [math.floor(scale * float(x)) for x in v])
        for i, lab, v in rows
        if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (_, a, lab, v) in enumerate(kept):
        if not asks(a):
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w, strict=True)), key, i, lab == other)
            for m, (key, i, other, w) in enumerate(kept)
            if m != n and len(w) == len(v)
        ]
        scored.sort(key=lambda r: r[:2])
        for s, _, p, _ in [r for r in scored if r[3]][:n_positives]:
            inside = [r for r in scored if not r[3] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a, p, k + 1, r[2], -s, -r[0]) for k, r in enumerate(inside[:n_negatives])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_query_equals_all_products(spark):
    sf = "/root/testdata/sf0.01"
    got = op12_hard_negatives(spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [
        (r["vec_id"], (r["label"] + 1) % 10 if r["label"] is not None and r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
        for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ]
    assert order(map(tuple, got.collect())) == order(plain(rows, lambda i: i is not None and i % 100 == 0))


@pytest.mark.parametrize(("block", "chunk", "spread"), [(4096, 2048, 1.0), (20, 7, 0.05), (20, 3, 1.0), (5, 100, 0.3)])
def test_blocks_ties_and_hard_rows(spark, block, chunk, spread):
    r = random.Random(block + chunk)
    centers = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, r.randrange(3), [x * r.choice([1, 1, 3]) + r.gauss(0, spread) for x in r.choice(centers)]) for i in range(250)]
    rows += [(300 + i, i % 2, [0.5, 0.5, 0.0, 0.0]) for i in range(40)]  # one vector many times: ties
    rows += rows[:30]  # repeated rows, anchors among them
    rows += [(500, 7, [1.0, 1.0, 1.0, 1.0]), (510, 1, [0.0] * 4), (None, 1, [0.5, 0.4, 0.1, 0.0]), (None, 0, [0.4, 0.5, 0.1, 0.0])]
    rows += [(520, None, [1.0] * 4), (530, 1, None), (540, 1, [1.0, None, 0.0, 0.0]), (550, 1, [float("nan")] * 4)]
    rows += [(560, 1, [1.0, 2.0]), (570, 0, [1.5, 0.5]), (580, 1, [0.5, 0.5]), (590, 1, []), (600, 0, []), (610, 1, [])]
    data = [(i, lab, v, "x", 1.0, 5) for i, lab, v in rows]
    df = spark.createDataFrame(data, "id bigint, label int, v array<double>, vec string, score double, uid int").repartition(3)
    got = hardneg.mine(df, "id", "label", "v", F.col("id") % 10 == 0, block=block, chunk=chunk)
    want = plain(rows, lambda i: i is not None and i % 10 == 0)
    assert order(map(tuple, got.collect())) == order(want)


def test_empty_and_wide(spark):
    schema = "id bigint, label int, v array<double>"
    empty = spark.createDataFrame([], schema)
    assert hardneg.mine(empty, "id", "label", "v", F.col("id") % 10 == 0).collect() == []
    rows = [(i, i % 2, [float(i), 1.0]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, schema)
    assert hardneg.mine(df, "id", "label", "v", F.lit(False)).collect() == []
    # Vectors whose products longs could not compare take no part.
    wide = spark.createDataFrame([*rows, (100, 1, [1e300, 0.0]), (200, 0, [-1e200, 5.0])], schema)
    got = hardneg.mine(wide, "id", "label", "v", F.col("id") % 10 == 0)
    assert order(map(tuple, got.collect())) == order(plain(rows, lambda i: i % 10 == 0))


def test_descent_skips_nodes(monkeypatch):
    """In clustered candidates most rows are never multiplied, and what is found is right."""
    r = np.random.default_rng(5)
    x = np.repeat(r.integers(-900, 900, (40, 8)), 100, axis=0) + r.integers(-9, 10, (4000, 8))
    labels = np.repeat(np.arange(40), 100) % 4
    norm = float((x * x).sum(axis=1).max()) ** 0.5
    tree, rows = Tree.build(hardneg.augmented(x, norm))
    block = hardneg.Candidates(tree, x[rows], labels[rows], rows.astype(np.int64), rows.astype(np.int64), norm)
    seen = []
    real = np.lexsort
    q = x[50]
    found = block.search(q, 50, int(labels[50]), [1], [1 << 60], 5, True)
    score = x @ q
    want = [i for i in real((np.arange(4000), -score)) if labels[i] == labels[50] and i != 50 and score[i] >= 1][:5]
    assert [f[3] for f in found] == want
    block.floats = type("Spy", (), {"__getitem__": lambda self, at: seen.append(np.size(at)) or block.x[at].astype(float)})()
    assert block.search(q, 50, int(labels[50]), [1], [1 << 60], 5, True) == found
    assert sum(seen) < 2000
