"""Keyed permutations: bijections for every size, and the rows they move."""

import pytest
from pyspark.sql import functions as F

from hexcadence.functions.permute import grid, permuted, round_keys
from hexcadence.operators.modelling import permuted_rows


def plain(x, n, seed):
    height, width = grid(n)
    while True:
        left, right = divmod(x, width)
        for i, (a, b, c) in enumerate(round_keys(seed)):
            mix = lambda d: (pow((d * a + b) % 2147483647, 2) + c) % 2147483647  # noqa: B023, E731
            if i % 2 == 0:
                left = (left + mix(right)) % height
            else:
                right = (right + mix(left)) % width
        x = left * width + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 13, 100, 101, 9999, 10007])
def test_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))
    assert got == [plain(i, n, 5) for i in range(n)]


def test_seeds_differ_large_numbers_and_edges(spark):
    n = (1 << 59) + 12345
    rows = [0, 1, 2, 10**9, 1 << 58, n - 1]
    df = spark.createDataFrame([(x,) for x in [*rows, n, -1, None]], "x bigint")
    got = [r[0] for r in df.select(permuted(F.col("x"), n, 1)).collect()]
    assert got == [plain(x, n, 1) for x in rows] + [None] * 3
    a, b = ([r[0] for r in spark.range(1000).select(permuted(F.col("id"), 1000, s)).collect()] for s in (1, 2))
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 20
    assert sum(x == i for i, x in enumerate(a)) < 20
    # No digit stays where it was: neighbours are torn apart.
    assert sum(abs(x - y) == 1 for x, y in zip(a, a[1:], strict=False)) < 20
    assert spark.range(1).select(permuted(F.col("id"), 0, 1)).first()[0] is None


def test_rows_move_by_the_formula(spark):
    df = spark.createDataFrame([(k, k * 10, None if k == 4 else f"v{k}") for k in range(30, 0, -1)], "k int, x int, s string").repartition(4)
    got = {r["k"]: r for r in permuted_rows(df, ["k"], ["x", "s"], 3, seed=9).collect()}
    assert sorted(got) == list(range(1, 31))
    for repeat in range(3):
        for i in range(30):
            target = got[plain(i, 30, 9 + repeat) + 1]
            moved = target["moved"][repeat]
            assert (moved["repeat"], moved["number"], moved["values"]["x"]) == (repeat, i, (i + 1) * 10)
            assert moved["values"]["s"] == (None if i + 1 == 4 else f"v{i + 1}")
    assert permuted_rows(df.limit(0), ["k"], ["x"], 2).collect() == []
