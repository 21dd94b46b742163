"""Runs of zeros against the dense cube they stand for."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hexcadence.operators import cube, windows, zeroruns

START = dt.datetime(2024, 1, 1)
SCHEMA = "cell string, bin timestamp_ntz, n bigint"


def counts(spark, data):
    rows = [(c, START + dt.timedelta(days=i), v) for c, vs in data.items() for i, v in enumerate(vs) if v]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def random_series():
    random.seed(11)
    share = {"a": 0.9, "b": 0.3, "c": 0.05, "d": 0.02}
    data = {c: [random.randint(1, 4) if random.random() < s else 0 for _ in range(120)] for c, s in share.items()}
    data["first"], data["last"] = [3] + [0] * 119, [0] * 119 + [2]
    return data


@pytest.mark.parametrize("calendar", ["observed", "full"])
@pytest.mark.parametrize("lags, rolls", [((1, 2, 4, 8), (4, 8)), ((3,), ()), ((), (2, 20)), ((), ())])
def test_features_equal_those_of_the_dense_cube(spark, random_series, calendar, lags, rolls):
    known = counts(spark, random_series).where("dayofweek(bin) <> 1")  # a bin that never occurs, each week
    bins = zeroruns.calendar_index(known, "bin", "daily", calendar)
    runs = zeroruns.feature_runs(known, "cell", "bin", "n", bins, lags, rolls)
    dense = windows.ts_features(cube.densify(known, "cell", "bin", "n", "daily", calendar=calendar), "cell", "bin", "n", lags, rolls)
    assert sorted(zeroruns.expand(runs, bins, "bin").columns) == sorted(dense.columns)
    assert plain(zeroruns.expand(runs, bins, "bin").select(*dense.columns)) == plain(dense)
    depth = max([*lags, *rolls], default=0)
    assert runs.count() <= known.count() * (depth + 2) + known.select("cell").distinct().count()


def test_runs_expand_to_the_dense_cube(spark, random_series):
    known = counts(spark, random_series)
    bins = zeroruns.calendar_index(known, "bin", "daily")
    runs = zeroruns.zero_runs(known, "cell", "bin", "n", bins, min_events=4)
    dense = cube.densify(known, "cell", "bin", "n", "daily", min_events=4)
    assert plain(zeroruns.expand(runs, bins, "bin").select(*dense.columns)) == plain(dense)
    assert runs.count() <= 2 * known.count() + len(random_series)


def test_long_gaps_write_few_rows(spark):
    known = spark.createDataFrame([("a", START, 1), ("a", START + dt.timedelta(days=3000), 1)], SCHEMA)
    bins = zeroruns.calendar_index(known, "bin", "daily", "full")
    assert zeroruns.zero_runs(known, "cell", "bin", "n", bins).count() == 3
    runs = zeroruns.feature_runs(known, "cell", "bin", "n", bins)
    assert runs.count() == 1 + 8 + 1 + 1 and runs.agg(F.sum("n_bins")).first()[0] == 3001
    last = runs.orderBy(F.desc("at")).first()
    assert (last.n, last.zero_streak, last.zero_streak_prev, last.lag_8) == (1, 0, 2999, 0)


def test_moments_equal_those_of_dense_rows(spark, random_series):
    known = counts(spark, random_series)
    bins = zeroruns.calendar_index(known, "bin", "daily", "full")
    runs = zeroruns.feature_runs(known, "cell", "bin", "n", bins)
    names = [c for c in runs.columns if c not in ("cell", "at", "n_bins")]
    dense = zeroruns.expand(runs, bins, "bin")
    want = dense.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names], F.count("*").alias("k")).first()
    got = zeroruns.moments(runs, "n", names).collect()
    assert len(got) == len(names)
    for r in got:
        assert r.n_rows == want["k"]
        assert r["mean"] == pytest.approx(want[f"m_{r.feature}"]) and r["std"] == pytest.approx(want[f"s_{r.feature}"])


def test_nulls_zeros_and_empty_frames(spark):
    odd = spark.createDataFrame(
        [("a", START, 2), ("a", START + dt.timedelta(days=2), None), ("b", START + dt.timedelta(days=1), 0),
         (None, START, 5), ("a", None, 7), ("a", START + dt.timedelta(days=3), 1)], SCHEMA,
    )
    bins = zeroruns.calendar_index(odd, "bin", "daily", "full")
    assert [r["at"] for r in bins.orderBy("bin").collect()] == [0, 1, 2, 3]
    runs = zeroruns.zero_runs(odd, "cell", "bin", "n", bins).orderBy("at").collect()
    assert [(r.cell, r["at"], r.n_bins, r.n) for r in runs] == [("a", 0, 1, 2), ("a", 1, 2, 0), ("a", 3, 1, 1)]
    for calendar in ("observed", "full"):
        none = zeroruns.calendar_index(odd.limit(0), "bin", "daily", calendar)
        assert none.count() == 0
        empty = zeroruns.feature_runs(odd.limit(0), "cell", "bin", "n", none)
        assert empty.count() == 0 and zeroruns.moments(empty, "n", ["lag_1"]).count() == 0
        assert zeroruns.expand(empty, none, "bin").count() == 0


def test_one_shuffle_by_cell(spark, random_series):
    known = counts(spark, random_series)
    bins = zeroruns.calendar_index(known, "bin", "daily", "full")
    plan = zeroruns.feature_runs(known, "cell", "bin", "n", bins)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(cell") == 1
