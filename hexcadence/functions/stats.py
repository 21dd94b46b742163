"""Aggregate expressions whose edge cases differ from Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation, null (not an error) when a side is constant."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def unbiased_skewness(c: Column | str) -> Column:
    """Sample skewness with the usual bias correction; null below three values."""
    c = _col(c)
    n = F.count(c).cast("double")
    g1 = F.when(F.stddev_pop(c) > 0, F.skewness(c)).otherwise(F.lit(0.0))
    return F.when(F.count(c) >= 3, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))


def unbiased_kurtosis(c: Column | str) -> Column:
    """Sample excess kurtosis with the usual bias correction; null below four values."""
    c = _col(c)
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + F.lit(6.0))
    return F.when(F.count(c) >= 4, F.when(F.stddev_pop(c) > 0, value).otherwise(F.lit(0.0)))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def stable_hash(*parts: Column | str, seed: int = 42) -> Column:
    """A repeatable 60-bit number from key columns; equal on every engine that has md5."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
