"""Lag, rolling and streak features per cell; all share one (cell, bin) order, so one shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The default feature set.
LAGS = (1, 2, 4, 8)
ROLLS = (4, 8)
ROLL_STATS = ("mean", "sum", "std")
MAX_ROLL_BY_LAGS = 16


def ts_features(
    df: DataFrame,
    cell: str,
    bin_col: str,
    target: str,
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    stats: Sequence[str] = ROLL_STATS,
) -> DataFrame:
    """Lags, rolling statistics of the previous rows, zero streaks and the last-bin flag.

    ``zero_streak`` counts the current row (it may leak a same-row target);
    ``zero_streak_prev`` is the value before the current row.
    """
    order = Window.partitionBy(cell).orderBy(bin_col)
    short = [k for k in rolls if k <= MAX_ROLL_BY_LAGS]
    depth = max([*lags, *short], default=0)
    # First pass: row number and the previous values as columns.  Short rolling statistics are then
    # plain arithmetic on them (null unless all k values are there), which is generated code,
    # where a sliding frame would be re-aggregated for every row.
    staged = df.withColumns(
        {
            "_rn": F.row_number().over(order),
            **{f"_p{k}": F.lag(target, k).over(order) for k in range(1, depth + 1)},
            **_sliding(order, target, [k for k in rolls if k > MAX_ROLL_BY_LAGS], stats),
        }
    )
    cols = {f"lag_{k}": F.coalesce(F.col(f"_p{k}"), F.lit(0)) for k in lags}
    for k in short:
        cols.update(_from_lags(k, stats))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reset = F.when((F.col(target) != 0) | (F.col("_rn") == 1), F.col("_rn"))
    # Second pass over the same order: distance to the last row with an event.
    cols["zero_streak"] = (F.col("_rn") - F.max(reset).over(upto)).cast("bigint")
    previous = F.col("_rn") - 1 - F.max(reset).over(before)
    cols["zero_streak_prev"] = F.coalesce(previous, F.lit(0)).cast("bigint")
    if 1 in lags:
        cols["had_event_last"] = F.coalesce((F.col("_p1") > 0).cast("int"), F.lit(0))
    out = staged.withColumns(cols)
    return out.drop("_rn", *[f"_p{k}" for k in range(1, depth + 1)])


def _from_lags(k: int, stats: Sequence[str]) -> dict:
    values = [F.col(f"_p{i}") for i in range(1, k + 1)]
    total = reduce(lambda a, b: a + b, values)
    mean = total / F.lit(float(k))
    out = {}
    if "mean" in stats:
        out[f"roll_mean_{k}"] = F.coalesce(mean, F.lit(0.0))
    if "sum" in stats:
        out[f"roll_sum_{k}"] = F.coalesce(total, F.lit(0))
    if "std" in stats:
        squares = reduce(lambda a, b: a + b, [(v - mean) * (v - mean) for v in values])
        std = F.sqrt(squares / F.lit(float(k - 1))) if k > 1 else F.lit(None).cast("double")
        out[f"roll_std_{k}"] = F.coalesce(std, F.lit(0.0))
    return out


def _sliding(order, target: str, rolls: Sequence[int], stats: Sequence[str]) -> dict:
    agg = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp}
    out = {}
    for k in rolls:
        w = order.rowsBetween(-k, -1)
        full = F.count(target).over(w) == k
        for s in stats:
            zero = F.lit(0) if s == "sum" else F.lit(0.0)
            out[f"roll_{s}_{k}"] = F.coalesce(F.when(full, agg[s](target).over(w)), zero)
    return out


def mean_abs_change(df: DataFrame, cell: str, bin_col: str, value: str) -> DataFrame:
    """Mean absolute difference to the previous bin of the same cell, over all rows."""
    order = Window.partitionBy(cell).orderBy(bin_col)
    step = F.abs(F.col(value) - F.lag(value).over(order))
    return df.select(step.alias("d")).agg(F.avg("d").alias("mean_abs_change"))


def next_bin_target(df: DataFrame, cell: str, bin_col: str, target: str, out: str = "y_next") -> DataFrame:
    """Features at t with the target at t + 1; rows of the last bin are dropped.

    On a complete grid only the last bin of a cell has no successor.
    """
    order = Window.partitionBy(cell).orderBy(bin_col)
    nxt = df.withColumn(out, F.lead(target, 1).over(order))
    return nxt.where(F.col(out).isNotNull())


def average_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Descending rank with the average position on ties (a feature list, a few hundred rows)."""
    order = Window.orderBy(F.col(value).desc())
    peers = Window.partitionBy(value)
    return df.withColumn(
        out, F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
    )


def drop_warmup(df: DataFrame, cell: str, bin_col: str, max_lag: int) -> DataFrame:
    """Without the first ``max_lag`` rows of each cell."""
    order = Window.partitionBy(cell).orderBy(bin_col)
    return (
        df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") > max_lag).drop("_rn")
    )


def one_hot(df: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in values})
