"""Count cubes and their zero-inflated form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.functions import timefn as T


def count_cube(df: DataFrame, cell: str, bin_col: str, out: str = "n") -> DataFrame:
    """Events per (cell, bin); rows without a cell are left out.

    The partial aggregate runs before the shuffle, so a hot cell sends at most one row per bin and
    task.
    """
    return df.where(F.col(cell).isNotNull()).groupBy(cell, bin_col).agg(F.count(F.lit(1)).alias(out))


def active_cells(counts: DataFrame, cell: str, value: str, min_events: int = 2) -> DataFrame:
    return (
        counts.groupBy(cell)
        .agg(F.sum(value).alias("total"))
        .where(F.col("total") >= min_events)
        .select(cell)
    )


def densify(
    counts: DataFrame,
    cell: str,
    bin_col: str,
    value: str,
    freq: str,
    *,
    min_events: int | None = None,
    calendar: str = "observed",
    span: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Every active cell with every bin; missing counts are 0.

    ``calendar="observed"`` keeps bins that occur somewhere in ``counts`` (before cells are
    dropped); ``"full"`` keeps every calendar bin between the first and the last.

    There is no cells x bins join: rows are shuffled once by cell (at most one row per bin and
    cell), and each row emits its own bin and the empty bins up to the next one.  ``span`` gives
    the first and last bin when they are known, which saves the scan for them.
    """
    step = T.frequency(freq).step
    if span is None:
        lo = counts.select(F.min(bin_col)).scalar()
        hi = counts.select(F.max(bin_col)).scalar()
    else:
        lo, hi = span
    by_cell = Window.partitionBy(cell)
    in_order = by_cell.orderBy(bin_col)
    rows = counts.where(F.col(cell).isNotNull()).select(
        cell,
        F.col(bin_col).alias("_bin"),
        F.col(value).alias("_value"),
        F.lead(bin_col).over(in_order).alias("_next"),
        F.row_number().over(in_order).alias("_rn"),
        F.sum(value).over(by_cell).alias("_total"),
    )
    if min_events is not None:
        rows = rows.where(F.col("_total") >= min_events)
    start = F.when(F.col("_rn") == 1, lo).otherwise(F.col("_bin"))
    stop = F.coalesce(F.col("_next") - step, hi)
    grid = rows.select(
        cell, "_bin", "_value", F.explode(F.sequence(start, stop, step)).alias(bin_col)
    ).select(
        cell,
        bin_col,
        F.when(F.col(bin_col) == F.col("_bin"), F.col("_value")).otherwise(0).alias(value),
    )
    if calendar == "full":
        return grid
    # The bin list is bounded by the calendar; the planner and adaptive execution choose the join.
    seen = counts.select(bin_col).distinct()
    return grid.join(seen, bin_col, "left_semi").select(cell, bin_col, value)


def complete_grid(
    df: DataFrame, key: str, keys: DataFrame, axis: str, axis_values: Sequence, value: str
) -> DataFrame:
    """All given keys x all given axis values, absent pairs 0.

    ``axis_values`` is a driver-side list (a parameter, not data).  Each key expands its own row,
    and real rows are merged in by one aggregate on (key, axis).
    """
    typed = df.schema[axis].dataType
    slots = F.array(*[F.lit(v).cast(typed) for v in axis_values])
    empty = keys.select(key).distinct().select(key, F.explode(slots).alias(axis), F.lit(0).alias(value))
    kept = df.select(key, axis, value).where(F.col(axis).isin(list(axis_values)))
    kept = kept.join(keys.select(key).distinct(), key, "left_semi")
    return (
        empty.withColumn(value, F.lit(0).cast(df.schema[value].dataType))
        .unionByName(kept)
        .groupBy(key, axis)
        .agg(F.sum(value).alias(value))
    )


def reaggregate(frames: Sequence[DataFrame], keys: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """Union of yearly cubes brought back to unique keys by ``sum`` or ``max``."""
    union = reduce(lambda a, b: a.unionByName(b), frames)
    fn = {"sum": F.sum, "max": F.max}[how]
    return union.groupBy(*keys).agg(fn(value).alias(value))


def with_target(df: DataFrame, value: str, out: str = "has_event") -> DataFrame:
    return df.withColumn(out, (F.col(value) > 0).cast("int"))


def daily_counts(df: DataFrame, day: str, limit: int = 10) -> DataFrame:
    """First days with their counts."""
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("n")).orderBy(day).limit(limit)


def region_month_counts(df: DataFrame, region: str, month: str, valid: Column) -> DataFrame:
    return df.where(valid).groupBy(region, month).agg(F.count(F.lit(1)).alias("n"))


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and the range of each column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def unpivot_cube_keys(
    df: DataFrame,
    cells: dict[int, str],
    bins: dict[str, Column],
    value: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows (resolution, cell, freq, bin[, value]) for every resolution and frequency."""
    cell_items = F.array(
        *[
            F.named_struct(F.lit("resolution"), F.lit(r), F.lit("cell"), F.col(c).cast("string"))
            for r, c in cells.items()
        ]
    )
    bin_items = F.array(
        *[F.named_struct(F.lit("freq"), F.lit(f), F.lit("time_bin"), b) for f, b in bins.items()]
    )
    base = [F.col(k) for k in keep] + ([F.col(value)] if value else [])
    names = [*keep, *([value] if value else [])]
    return (
        df.select(*base, F.explode(cell_items).alias("_c"), bin_items.alias("_bins"))
        .where(F.col("_c.cell").isNotNull())
        .select(*names, "_c", F.explode("_bins").alias("_b"))
        .where(F.col("_b.time_bin").isNotNull())
        .select(*names, "_c.resolution", "_c.cell", "_b.freq", "_b.time_bin")
    )


def category_mix(df: DataFrame, cell: str, bin_col: str, category: str, top: Sequence[str]) -> DataFrame:
    """Per (cell, bin): share of each named value and of the rest, entropy, distinct values, top share.

    Counts per (cell, bin, value) come first, so the second aggregate sees one row per value.
    """
    counts = (
        df.where(F.col(cell).isNotNull() & F.col(category).isNotNull())
        .groupBy(cell, bin_col, category)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n, total = F.col("_n").cast("double"), F.sum("_n").cast("double")
    named = [
        (F.sum(F.when(F.col(category) == v, F.col("_n")).otherwise(0)) / total).alias(f"ratio_{v}")
        for v in top
    ]
    other = F.sum(F.when(~F.col(category).isin(list(top)), F.col("_n")).otherwise(0)) / total
    # -sum p ln p = ln N - sum(n ln n) / N
    entropy = F.ln(total) - F.sum(n * F.ln(n)) / total
    return counts.groupBy(cell, bin_col).agg(
        *named,
        other.alias("ratio_other"),
        entropy.alias("entropy"),
        F.count(F.lit(1)).alias("n_values"),
        (F.max(n) / total).alias("max_ratio"),
    )


def target_mean_encode(df: DataFrame, group: str, target: str) -> DataFrame:
    """Group column replaced by the mean target of its group.

    Means are aggregated first and joined back, so a hot group never meets in one window task.
    """
    means = df.groupBy(group).agg(F.avg(target).alias(f"{group}_te"))
    return df.join(means, group, "left").drop(group)


def smoothed_encoding(df: DataFrame, group: str, target: str, alpha: float = 10.0) -> DataFrame:
    """Per group ``(n * mean + alpha * global mean) / (n + alpha)``."""
    stats = df.groupBy(group).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    overall = df.select(F.avg(target)).scalar()
    return stats.select(
        group,
        ((F.col("_s") + F.lit(alpha) * overall) / (F.col("_n") + F.lit(alpha))).alias(f"{group}_te"),
        overall.alias("global_mean"),
    )


def apply_encoding(df: DataFrame, encoding: DataFrame, group: str, fallback: str | None = None) -> DataFrame:
    """Join a fitted encoding; unseen groups take the fallback column of the encoding."""
    out = df.join(encoding.select(group, f"{group}_te"), group, "left")
    if fallback:
        default = encoding.select(F.max(fallback)).scalar()
        out = out.withColumn(f"{group}_te", F.coalesce(f"{group}_te", default))
    return out
