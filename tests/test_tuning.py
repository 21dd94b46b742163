"""Folds, cross-fitting and halving on small frames."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from hexcadence.operators import boosting, tuning
from hexcadence.operators.boosting import PRESETS

SMALL = {"a": replace(PRESETS["symmetric"], depth=2, rounds=2, learning_rate=0.5), "b": replace(PRESETS["regularised"], depth=1, rounds=2, rows=1.0, columns=1.0)}


def frame(spark, n=120):
    r = random.Random(2)
    rows = [(i, i // 6, float(r.randrange(9)), float(r.randrange(9)) if i % 11 else None) for i in range(n)]
    return spark.createDataFrame([(k, t, x, y, int(x + (y or 0) > 8) if k != 5 else None) for k, t, x, y in rows], "k int, t int, x double, y double, label int")


def test_rungs():
    assert tuning.rungs(6, 3) == [([1], 6, 3), ([2], 3, 2), ([3], 2, 1)]
    assert tuning.rungs(4, 5) == [([1], 4, 2), ([2, 3, 4, 5], 2, 1)]
    assert tuning.rungs(1, 2) == [([1, 2], 1, 1)]
    assert tuning.rungs(8, 2) == [([1], 8, 4), ([2], 4, 1)]


def test_cross_fit_never_sees_its_fold(spark):
    df = frame(spark).withColumn("fold", F.when(F.col("k") != 7, tuning.row_folds(["k"], 3)))
    got = tuning.cross_fit(df, ["k"], "label", ["x", "y"], "fold", 3, SMALL).collect()
    assert sorted({r["k"] for r in got}) == [k for k in range(120) if k != 7]
    assert len(got) == 2 * 119 and all(r["n_own_fold"] == 0 for r in got)
    sizes = {r["fold"]: r["n_fitted"] for r in got}
    folds = {r["k"]: r["fold"] for r in got}
    assert all(n == sum(f != fold and k != 5 for k, f in folds.items()) for fold, n in sizes.items())
    # The same models, fitted by hand without one fold.
    train = df.where("fold != 1")
    cuts = boosting.bin_cuts(train, ["x", "y"])
    model = boosting.fit(boosting.binned(train, cuts), ["k"], "label", {"a": SMALL["a"]}, ["x", "y"])["a"]
    want = {r["k"]: r["y_proba"] for r in boosting.predict(boosting.binned(df.where("fold = 1"), cuts), model).collect()}
    assert {r["k"]: r["y_proba"] for r in got if r["fold"] == 1 and r["model"] == "a"} == want


def test_halving_keeps_losers_and_breaks_ties_by_order(spark):
    df = frame(spark)
    configs = {"one": SMALL["b"], "same": SMALL["b"], "deep": SMALL["a"]}
    got = tuning.halving(df, "t", ["k"], "label", ["x", "y"], configs, 3, gap=1).collect()
    first = {r["config"]: r for r in got if r["rung"] == 0}
    assert set(first) == set(configs) and first["one"]["rank"] < first["same"]["rank"]
    assert sum(r["kept"] for r in first.values()) == 2
    last = [r for r in got if r["rung"] == max(r["rung"] for r in got)]
    assert len({r["config"] for r in last if r["kept"]}) == 1
    for r in got:
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 30 - (r["fold"] == 0)
        assert abs(r["f2"] - 5 * r["tp"] / max(1, 5 * r["tp"] + 4 * r["fn"] + r["fp"])) < 1e-12
