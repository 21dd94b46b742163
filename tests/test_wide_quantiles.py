"""Quantiles of many columns from shared scans, against numpy."""

import numpy as np
import pandas as pd
import pytest

from hexcadence.functions import ranks
from hexcadence.operators import clean

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    n = 20_000
    data = {
        "even": rng.random(n),
        "few": rng.integers(0, 7, n).astype(float),
        "one": np.full(n, 3.5),
        "skewed": np.where(rng.random(n) < 0.4, 0.0, rng.exponential(9.0, n)),
        "signed": np.round(rng.normal(size=n), 3),
    }
    return pd.DataFrame(data)


def by_key(df):
    return {(r["column"], r.prob): r["quantile"] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 500, 20_000])
def test_equal_to_linear_interpolation(spark, numbers, n):
    cut = numbers.head(n)
    got = by_key(ranks.wide_quantiles(spark.createDataFrame(cut).repartition(6), cut.columns, PROBS))
    assert len(got) == len(PROBS) * len(cut.columns)
    for (c, p), q in got.items():
        assert q == pytest.approx(np.quantile(cut[c], p), abs=1e-12), (c, p)


def test_nulls_empty_columns_and_frames(spark):
    df = spark.createDataFrame([(1.0, None, 4), (None, None, 2), (3.0, None, 9)], "a double, b double, c int")
    got = by_key(ranks.wide_quantiles(df, ["a", "b", "c"], [0.5]))
    assert got == {("a", 0.5): 2.0, ("c", 0.5): 4.0}
    assert by_key(ranks.wide_quantiles(df.limit(0), ["a", "c"], [0.5])) == {}


def test_discrete_columns_send_no_values(spark, numbers, monkeypatch):
    """A bracket of one value is answered by the sketch: nothing is sent out for it."""
    monkeypatch.setattr(ranks, "running_totals", None)
    got = by_key(ranks.wide_quantiles(spark.createDataFrame(numbers), ["few", "one"], [0.25, 0.5]))
    assert got[("one", 0.5)] == 3.5 and got[("few", 0.25)] == np.quantile(numbers["few"], 0.25)


def test_imputation_takes_all_medians_at_once(spark):
    df = spark.createDataFrame([(1.0, 4, "x"), (None, None, None), (3.0, 9, "x")], "a double, b int, t string")
    rows = clean.impute(df, ["a", "b", "t", "absent"]).where("a = 2.0").collect()
    assert [(r.a, r.b, r.t) for r in rows] == [(2.0, 6.5, "x")]
