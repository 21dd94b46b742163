"""Boosted trees against a plain implementation over lists."""

import math
import random
from dataclasses import replace
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from hexcadence.operators import boosting
from hexcadence.operators.boosting import PRESETS, UNIT


def draw(key, seed):
    return int(md5(f"{key}|{seed}".encode()).hexdigest()[:15], 16) / float(1 << 60)


def plain(rows, p, n_features, seed=42):
    """rows: (key, bins, y); one node at a time, every cut measured by filtering the rows."""
    score = {k: 0.0 for k, _, _ in rows}
    trees = []
    for t in range(p.rounds):
        data = []
        for k, b, y in rows:
            c = 1 / (1 + math.exp(-score[k]))
            data.append((b, math.floor((c - y) * UNIT + 0.5), math.floor(c * (1 - c) * UNIT + 0.5), draw(k, seed + t) < p.rows or p.rows >= 1))
        seen = [d for d in data if d[3]]
        usable = boosting.tree_features(n_features, p.columns, t, seed)
        l2 = p.l2 * UNIT
        sums = lambda part: (len(part), sum(d[1] for d in part), sum(d[2] for d in part))
        score_of = lambda s: float(s[1]) ** 2 / (s[2] + l2) if s[2] + l2 > 0 else 0.0

        def cuts(part):
            for f in usable:
                for c in sorted({d[0][f] for d in part})[:-1]:
                    yield f, c, sums([d for d in part if d[0][f] <= c]), sums([d for d in part if d[0][f] > c])

        def best(part):
            found = None
            for f, c, a, b in cuts(part):
                if min(a[0], b[0]) >= p.min_rows and min(a[2], b[2]) >= p.min_weight * UNIT:
                    gain = score_of(a) + score_of(b) - score_of(sums(part))
                    if gain > 0 and (found is None or gain > found[0]):
                        found = (gain, f, c)
            return found

        parts, inner = {1: seen}, {}

        def split(i, f, c):
            inner[i] = (f, c)
            part = parts.pop(i)
            parts[2 * i], parts[2 * i + 1] = [d for d in part if d[0][f] <= c], [d for d in part if d[0][f] > c]

        if p.growth == "level":
            for d in range(p.depth):
                for i in [i for i in parts if i.bit_length() == d + 1]:
                    if found := best(parts[i]):
                        split(i, *found[1:])
        elif p.growth == "leaf":
            while len(parts) < p.leaves:
                found = [(-b[0], i, b) for i in parts if (b := best(parts[i]))]
                if not found:
                    break
                _, i, b = min(found)
                split(i, *b[1:])
        else:
            for _ in range(p.depth):
                top = None
                for f in usable:
                    for c in sorted({d[0][f] for d in seen})[:-1]:
                        after = sum(score_of(sums([d for d in x if d[0][f] <= c])) + score_of(sums([d for d in x if d[0][f] > c])) for x in parts.values())
                        gain = math.floor((after - sum(score_of(sums(x)) for x in parts.values())) * 1000 + 0.5)
                        if gain > 0 and (top is None or gain > top[0]):
                            top = (gain, f, c)
                if not top:
                    break
                for i in list(parts):
                    split(i, *top[1:])
        value = {i: -p.learning_rate * s[1] / (s[2] + l2) if s[2] + l2 > 0 else 0.0 for i, x in parts.items() for s in [sums(x)]}
        trees.append((inner, {i: (round(v, 12), len(parts[i])) for i, v in value.items()}))
        for k, b, _ in rows:
            i = 1
            while i in inner:
                f, c = inner[i]
                i = 2 * i + (b[f] > c)
            score[k] += value[i]
    return trees, {k: 1 / (1 + math.exp(-s)) for k, s in score.items()}


@pytest.mark.parametrize("name", list(PRESETS))
def test_trees_equal_plain(spark, name):
    r = random.Random(7)
    rows = [(i, [r.randrange(6) for _ in range(4)], 0) for i in range(160)]
    rows = [(i, b, int(b[0] + b[1] * (b[2] > 2) + r.randrange(3) > 6)) for i, b, _ in rows]
    preset = replace(PRESETS[name], rounds=3, learning_rate=0.4, min_rows=min(PRESETS[name].min_rows, 5), leaves=9, depth=min(PRESETS[name].depth, 4))
    df = spark.createDataFrame(rows, "k int, bins array<int>, y int").repartition(3)
    model = boosting.fit(df, ["k"], "y", {"m": preset}, ["a", "b", "c", "d"])["m"]
    want, chance = plain(rows, preset, 4)
    for tree, (inner, leaves) in zip(model.trees, want, strict=True):
        assert {i: (v.feature, v.cut) for i, v in tree.items() if v.feature is not None} == inner
        assert {i: (round(v.value, 12), v.n) for i, v in tree.items() if v.feature is None} == leaves
    got = {x["k"]: x["y_proba"] for x in boosting.predict(df, model, step=2).collect()}
    assert all(abs(got[k] - chance[k]) < 1e-9 for k in chance)


def test_bins_nulls_and_edges(spark):
    rows = [(i, float(i % 10) if i % 7 else None, float("nan") if i == 3 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    cuts = boosting.bin_cuts(df, ["a", "b"], 4)
    got = {r["k"]: r["bins"] for r in boosting.binned(df, cuts).collect()}
    assert got[0][0] == 0 and got[3][1] == 0
    assert all(got[k][1] == 1 + sum(k > c for c in cuts["b"]) for k in range(4, 100))
    assert len(cuts["a"]) == len(cuts["b"]) == 3


def test_no_rows_one_class_and_missing_labels(spark):
    schema = "k int, bins array<int>, y int"
    small = {m: replace(p, rounds=2) for m, p in PRESETS.items()}
    empty = boosting.fit(spark.createDataFrame([], schema), ["k"], "y", small, ["a"])
    assert all(tree[1].value == 0.0 for m in empty.values() for tree in m.trees)
    one = boosting.fit(spark.createDataFrame([(i, [i % 3], 1) for i in range(60)] + [(99, [2], None)], schema), ["k"], "y", small, ["a"])
    assert all(v.value > 0 for m in one.values() for tree in m.trees for v in tree.values() if v.feature is None)
    assert one["symmetric"].trees[0][1].n == 60
    table = boosting.tree_table(one, spark)
    assert table.where("feature IS NULL AND value IS NULL").count() == 0


def test_models_share_passes_and_learn(spark):
    r = random.Random(1)
    rows = [(i, r.random(), r.random()) for i in range(600)]
    df = spark.createDataFrame([(i, a, b, int((a > 0.5) != (b > 0.5))) for i, a, b in rows], "k int, a double, b double, y int")
    data = boosting.binned(df, boosting.bin_cuts(df, ["a", "b"]))
    quick = {m: replace(p, rounds=6, learning_rate=0.5) for m, p in PRESETS.items()}
    together = boosting.fit(data, ["k"], "y", quick, ["a", "b"])
    alone = boosting.fit(data, ["k"], "y", {"leafwise": quick["leafwise"]}, ["a", "b"])
    assert together["leafwise"].trees == alone["leafwise"].trees
    for m in together.values():
        right = boosting.predict(data, m).agg(F.avg(((F.col("y_proba") > 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]
        assert right > 0.9
