"""Keyed permutations of row numbers by formula: a Feistel network on a grid of two digits.

A number below n is written as two digits, x = left * width + right, on a grid that just covers n. Each half-round adds a
keyed function of one digit to the other one, modulo that digit's base, which can be undone; so the rounds permute the
grid. The few numbers of the grid that are not below n are walked past: the formula is applied again until the result is
below n, which leaves a permutation of 0..n-1. No sort and no table is needed to know where a row goes.
"""

from __future__ import annotations

import math
from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = (1 << 31) - 1
WALK = 64
HALF_ROUNDS = 6  #: an even number, so that the digits end in their places


def round_keys(seed: int, half_rounds: int = HALF_ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for every half-round; the first is not 0."""
    out = []
    for i in range(half_rounds):
        digest = md5(f"{seed}|{i}".encode()).hexdigest()
        a, b, c = (int(digest[k : k + 8], 16) % (_PRIME - 1) for k in (0, 8, 16))
        out.append((a + 1, b, c))
    return out


def grid(n: int) -> tuple[int, int]:
    """(height, width) with height * width >= n and both near its root, as few numbers beyond n as that allows."""
    width = max(1, math.isqrt(n))
    return max(1, -(-n // width)), width


def _once(x: Column, n: int, seed: int) -> Column:
    """All half-rounds as a fold over their keys: the digit that was changed comes second, the other one is changed next."""
    height, width = grid(n)
    keys = [
        F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(("a", "b", "c", "base"), (*key, (height, width)[i % 2]), strict=True)])
        for i, key in enumerate(round_keys(seed))
    ]
    high = (x - x % F.lit(width)) / F.lit(width).cast("decimal(20,0)")
    start = F.struct(high.cast("bigint").alias("l"), (x % F.lit(width)).cast("bigint").alias("r"))

    def step(digits: Column, key: Column) -> Column:
        u = (digits["r"] * key["a"] + key["b"]) % F.lit(_PRIME)
        mixed = (u * u + key["c"]) % F.lit(_PRIME)
        return F.struct(digits["r"].alias("l"), ((digits["l"] + mixed) % key["base"]).alias("r"))

    return F.aggregate(F.array(*keys), start, step, lambda d: d["l"] * F.lit(width) + d["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """Where number x of 0..n-1 goes; every number is hit once. ``n`` may be up to 2^60.

    A null stays null; numbers outside 0..n-1 give null.
    """
    if n <= 0:
        return F.lit(None).cast("bigint")
    height, width = grid(n)
    x = F.when((x >= 0) & (x < n), x.cast("bigint"))
    first = _once(x, n, seed)
    beyond = height * width - n
    if beyond == 0:
        return first
    # A walk leaves the rest of the grid after ``beyond`` steps at most. About one row in ``height`` walks at all, and of those one
    # in ``height`` takes another step: where ``beyond`` is larger, WALK steps are exceeded with a chance below 2^-300.
    steps = F.array(*[F.lit(i) for i in range(min(beyond, WALK))])
    walked = F.aggregate(steps, first, lambda v, _: F.when(v < n, v).otherwise(_once(v, n, seed)))
    done = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk past the last number did not end; take another seed")))
    return F.when(x.isNull() | (first < n), first).otherwise(done)
