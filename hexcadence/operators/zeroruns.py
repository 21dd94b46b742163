"""Series with long runs of zeros, kept as runs: what is written follows the events, not cells x bins.

Bins are numbered along a calendar (``calendar_index``).  A run is ``at`` (number of its first bin), ``n_bins`` (how many
bins it spans), the value and, for features, their values at ``at``.  Behind an event the lags and rolling statistics
change for as many bins as the longest of them reaches; from then on all are zero and only the streak grows, by one a
bin, so that the rest of the gap is one run.  ``expand`` gives the dense rows, ``moments`` their means and deviations
without writing them.

Input frames hold one row per (cell, bin).  A value that is null or 0 counts as no event; rows without a cell or a bin,
and cells without any event, have no runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.functions import timefn as T
from hexcadence.functions.ranks import dense_index
from hexcadence.operators import windows

STREAKS = ("zero_streak", "zero_streak_prev")


def calendar_index(counts: DataFrame, bin_col: str, freq: str, calendar: str = "observed") -> DataFrame:
    """Bins with their numbers ``at`` from 0: those that occur (``observed``), or all from first to last (``full``).

    The frame has one row per bin of the calendar, however many events there are.
    """
    if calendar == "observed":
        seen = counts.select(bin_col).where(F.col(bin_col).isNotNull()).distinct()
        return dense_index(seen, [bin_col], "at")
    limits = counts.agg(F.min(bin_col).alias("lo"), F.max(bin_col).alias("hi")).where("lo IS NOT NULL")
    steps = F.sequence("lo", "hi", T.frequency(freq).step)
    return limits.select(F.posexplode(steps).alias("at", bin_col)).select(bin_col, F.col("at").cast("bigint").alias("at"))


def _events(
    counts: DataFrame, cell: str, bin_col: str, value: str, bins: DataFrame, min_events: int | None, extra: dict | None = None
) -> DataFrame:
    """Event rows with the numbers of the events beside them; one shuffle by cell."""
    by_cell = Window.partitionBy(cell)
    order = by_cell.orderBy("_p")
    n_all = bins.agg(F.coalesce(F.max("at") + 1, F.lit(0))).scalar()
    rows = (
        counts.where(F.col(cell).isNotNull() & (F.col(value) != 0))
        .join(bins, bin_col)
        .select(cell, F.col("at").alias("_p"), F.col(value).alias("_v"))
        .select(
            cell,
            "_p",
            "_v",
            F.lag("_p").over(order).alias("_before"),
            F.coalesce(F.lead("_p").over(order), n_all).alias("_next"),
            F.sum("_v").over(by_cell).alias("_total"),
            *[c.over(order.rowsBetween(-deep, -1)).alias(name) for name, (c, deep) in (extra or {}).items()],
        )
    )
    return rows.where(F.col("_total") >= min_events) if min_events is not None else rows


def zero_runs(
    counts: DataFrame, cell: str, bin_col: str, value: str, bins: DataFrame, min_events: int | None = None
) -> DataFrame:
    """Run-length form of the dense cube: a row per event and one per gap (``value`` 0); at most 2 x events + cells rows."""
    p, nothing = F.col("_p"), F.lit(0).cast(counts.schema[value].dataType)

    def run(at: Column, n: Column, v: Column) -> Column:
        return F.struct(at.alias("at"), n.cast("bigint").alias("n_bins"), v.alias(value))

    parts = F.array(
        run(F.lit(0).cast("bigint"), F.when(F.col("_before").isNull(), p).otherwise(0), nothing),
        run(p, F.lit(1), F.col("_v")),
        run(p + 1, F.col("_next") - p - 1, nothing),
    )
    rows = _events(counts, cell, bin_col, value, bins, min_events)
    return rows.select(cell, F.inline(parts)).where(F.col("n_bins") > 0)


def feature_runs(
    counts: DataFrame,
    cell: str,
    bin_col: str,
    value: str,
    bins: DataFrame,
    lags: Sequence[int] = windows.LAGS,
    rolls: Sequence[int] = windows.ROLLS,
    stats: Sequence[str] = windows.ROLL_STATS,
    min_events: int | None = None,
) -> DataFrame:
    """The columns of ``windows.ts_features`` as runs: at most events x (longest reach + 2) + cells rows.

    An event sends a row for its own bin and one for each of the ``depth`` bins behind it, up to the next event; the rest
    of the gap, and the gap before a cell's first event, are one row each.
    """
    depth = max([*lags, *rolls], default=0)
    past = F.collect_list(F.struct("_p", "_v"))
    rows = _events(counts, cell, bin_col, value, bins, min_events, {"_past": (past, depth)} if depth else None)
    p, t, first = F.col("_p"), F.col("at"), F.col("_before").isNull()
    starts = F.sequence(p, F.least(p + depth + 1, F.col("_next") - 1))
    leading = F.when(first & (p > 0), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    known = [F.map_from_entries("_past").alias("_past")] if depth else []
    each = rows.select(cell, "_p", "_v", "_before", "_next", *known, F.explode(F.concat(leading, starts)).alias("at"))
    nothing = F.lit(0).cast(counts.schema[value].dataType)

    def back(k: int) -> Column:
        """Value k bins earlier; null before the calendar starts, as a lag is."""
        at = t - k
        older = F.coalesce(F.try_element_at("_past", at), nothing)
        return F.when(at < 0, None).when(at == p, F.col("_v")).when(at > p, nothing).otherwise(older)

    is_leading, is_event = t < p, t == p
    staged = each.select(
        cell,
        "at",
        F.when(is_leading, p).when(t == p + depth + 1, F.col("_next") - t).otherwise(1).cast("bigint").alias("n_bins"),
        F.when(is_event, F.col("_v")).otherwise(nothing).alias(value),
        F.when(is_leading | is_event, 0).otherwise(t - p).cast("bigint").alias("zero_streak"),
        F.when(is_leading, 0)
        .when(is_event, F.when(first, F.greatest(p - 1, F.lit(0))).otherwise(p - 1 - F.col("_before")))
        .otherwise(t - p - 1)
        .cast("bigint")
        .alias("zero_streak_prev"),
        *[back(k).alias(f"_p{k}") for k in range(1, depth + 1)],
    )
    cols = {f"lag_{k}": F.coalesce(F.col(f"_p{k}"), F.lit(0)) for k in lags}
    for k in rolls:
        cols.update(windows._from_lags(k, stats))
    if 1 in lags:
        cols["had_event_last"] = F.coalesce((F.col("_p1") > 0).cast("int"), F.lit(0))
    return staged.withColumns(cols).drop(*[f"_p{k}" for k in range(1, depth + 1)])


def expand(runs: DataFrame, bins: DataFrame, bin_col: str) -> DataFrame:
    """Dense rows of runs, with their bins; the streaks grow by one a bin, all other columns stay."""
    step = F.col("_step")
    grown = {}
    if "zero_streak" in runs.columns:
        now = F.col("zero_streak") + step
        grown["zero_streak"] = now
        grown["zero_streak_prev"] = F.when(step == 0, F.col("zero_streak_prev")).otherwise(now - 1)
    rows = runs.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1)).alias("_step"))
    rows = rows.withColumns({"at": F.col("at") + step, **grown}).drop("_step", "n_bins")
    return rows.join(bins, "at").drop("at")


def moments(runs: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """One row per column: number, mean and sample deviation over the dense rows, from the runs alone.

    A streak that starts a run at ``a`` and grows over m bins sums to m a + m (m - 1) / 2, its squares to
    m a^2 + a m (m - 1) + (m - 1) m (2 m - 1) / 6.
    """
    n = F.col("n_bins").cast("double")
    # The streak before a cell's first event starts 0, 0, 1, ...: one bin that adds nothing, then it grows.
    late = (F.col("zero_streak") == 0) & (F.col(value) == 0) if "zero_streak" in runs.columns else F.lit(False)

    def sums(c: str) -> tuple[Column, Column]:
        a = F.col(c).cast("double")
        if c not in STREAKS:
            return n * a, n * a * a
        m = F.when(late, n - 1).otherwise(n) if c == "zero_streak_prev" else n
        return m * a + m * (m - 1) / 2, m * a * a + a * m * (m - 1) + (m - 1) * m * (2 * m - 1) / 6

    totals = [F.sum("n_bins").alias("_n")]
    for i, c in enumerate(columns):
        one, two = sums(c)
        totals += [F.sum(one).alias(f"_a{i}"), F.sum(two).alias(f"_b{i}")]
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(f"_a{i}").alias("s1"), F.col(f"_b{i}").alias("s2"))
        for i, c in enumerate(columns)
    ]
    count = F.col("_n").cast("double")
    spread = F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / count) / (count - 1), F.lit(0.0))
    return (
        runs.agg(*totals)
        .where("_n IS NOT NULL")
        .select("_n", F.inline(F.array(*entries)))
        .select(
            "feature",
            F.col("_n").alias("n_rows"),
            (F.col("s1") / count).alias("mean"),
            F.when(count > 1, F.sqrt(spread)).alias("std"),
        )
    )
