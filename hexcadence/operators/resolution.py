"""How good is a (resolution, frequency) choice?  Distribution and stability of its count cube.

Two forms give the same numbers:

* functions on a dense cube (``base_stats`` ... ``event_intensity``), for one cube at hand;
* ``sweep``, for all choices at once, on the sparse counts only: the zero rows of the dense grid
  enter every formula as a number, so a grid of cells x bins rows is never built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.functions import timefn as T
from hexcadence.functions.ranks import running_totals, value_histogram, wide_quantiles
from hexcadence.functions.stats import safe_corr
from hexcadence.operators import cube
from hexcadence.session import materialise

# The reported quantiles and the weights of the composite scores.
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
MEAN_FLOOR = 1e-6
SCORE_WEIGHTS = {"entropy": 0.4, "non_zero_share": 0.3, "var": -0.3, "stability": 0.2}
FINAL_WEIGHTS = {"active_bins_median": 0.6, "median_non_zero_median": 0.4}
MIN_NON_ZERO_SHARE, MIN_ROWS, TOP_CHOICES = 0.05, 1000, 10
NORM_EPSILON = 1e-9


# --- moments from a value histogram -------------------------------------------------------------


def _moment_aggs(value: str, freq: str) -> list[Column]:
    v, f = F.col(value).cast("double"), F.col(freq)
    fd = f.cast("double")
    return [
        F.sum(f).alias("rows"),
        F.sum(F.col(value) * f).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(F.when(v != 0, f).otherwise(0)).alias("non_zero_count"),
        F.sum(fd * v).alias("_s1"),
        F.sum(fd * v * v).alias("_s2"),
        F.sum(F.when(v > 0, fd * v * F.ln(v))).alias("_xlogx"),
        F.percentile(value, F.array(*[F.lit(p) for p in QUANTILES.values()]), f).alias("_q"),
    ]


def _from_moments(agg: DataFrame, groups: Sequence[str]) -> DataFrame:
    n = F.col("rows").cast("double")
    mean = F.col("_s1") / n
    var = F.greatest(F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / n, n - 1), F.lit(0.0))
    staged = agg.withColumns({"_mean": mean, "var": F.when(n > 1, var)})
    shown_mean = F.when(F.col("_mean") > MEAN_FLOOR, F.col("_mean"))
    return staged.select(
        *groups,
        "rows",
        "sum",
        "min",
        shown_mean.alias("mean"),
        "var",
        F.sqrt("var").alias("std"),
        F.when(F.col("_mean") > MEAN_FLOOR, F.col("var") / F.col("_mean")).alias("dispersion"),
        *[F.col("_q")[i].alias(name) for i, name in enumerate(QUANTILES)],
        "max",
        "non_zero_count",
        (F.col("non_zero_count") / n).alias("non_zero_share"),
        (F.col("rows") - F.col("non_zero_count")).alias("zero_count"),
        ((F.col("rows") - F.col("non_zero_count")) / n).alias("zero_share"),
        # entropy of the mass: -sum p ln p with p = x / S  =  ln S - sum(x ln x) / S
        F.when(F.col("_s1") > 0, F.ln("_s1") - F.coalesce("_xlogx", F.lit(0.0)) / F.col("_s1")).alias(
            "entropy"
        ),
    )


def base_stats(df: DataFrame, value: str) -> DataFrame:
    """One row of moments, quantiles and shares of a count column.

    Distinct counts are few (at most the square root of twice the events), so their exact quantiles
    fit one buffer; use ``exact_quantiles`` for measured values.
    """
    hist = value_histogram(df, value)
    return _from_moments(hist.agg(*_moment_aggs(value, "n_rows")), []).drop("entropy")


def entropy(df: DataFrame, value: str, kind: str = "mass") -> DataFrame:
    """``mass``: of each row's share in the total; ``histogram``: of the distribution of values."""
    if kind == "mass":
        x = F.col(value).cast("double")
        sums = df.agg(
            F.sum(x).alias("s"), F.sum(F.when(x > 0, x * F.ln(x))).alias("xlogx")
        )
        return sums.select(
            F.when(F.col("s") > 0, F.ln("s") - F.coalesce("xlogx", F.lit(0.0)) / F.col("s")).alias("entropy")
        )
    hist = value_histogram(df, value)
    f = F.col("n_rows").cast("double")
    sums = hist.agg(F.sum(f).alias("s"), F.sum(f * F.ln(f)).alias("xlogx"))
    return sums.select((F.ln("s") - F.col("xlogx") / F.col("s")).alias("entropy"))


def gini(df: DataFrame, value: str, zero_sum: float | None = None) -> DataFrame:
    """Gini index of the non-negative values; ``zero_sum`` is the result when they add up to 0.

    Equal values share one row with the closed-form sum of their ranks, so nothing is sorted row
    by row.
    """
    hist = value_histogram(df.where(F.col(value) >= 0), value)
    ranked = running_totals(hist, value, {"before": "n_rows"})
    return _gini(ranked, value, [], zero_sum)


def _rank_sum(value: str) -> Column:
    """Sum of rank x value over blocks of ``n_rows`` equal values after ``before`` smaller ones."""
    f, c = F.col("n_rows").cast("double"), F.col("before").cast("double")
    return F.sum(F.col(value).cast("double") * f * (2 * c + f + 1) / 2)


def _gini(ranked: DataFrame, value: str, groups: Sequence[str], zero_sum: float | None = None) -> DataFrame:
    f, v = F.col("n_rows").cast("double"), F.col(value).cast("double")
    sums = ranked.groupBy(*groups).agg(
        F.sum(f).alias("_n"),
        F.sum(f * v).alias("_s"),
        _rank_sum(value).alias("_w"),
    )
    n, s = F.col("_n"), F.col("_s")
    value_out = F.when(s > 0, 2 * F.col("_w") / (n * s) - (n + 1) / n)
    if zero_sum is not None:
        value_out = F.coalesce(value_out, F.when(n > 0, F.lit(float(zero_sum))))
    return sums.select(*groups, value_out.alias("gini"))


# --- dense cube: per-cell metrics ---------------------------------------------------------------


def time_stability(df: DataFrame, cell: str, bin_col: str, value: str) -> DataFrame:
    """Mean lag-1 correlation of the cells, share of cells without one, mean absolute change."""
    order = Window.partitionBy(cell).orderBy(bin_col)
    pairs = df.select(cell, F.col(value).alias("_y"), F.lag(value).over(order).alias("_p"))
    per_cell = pairs.groupBy(cell).agg(
        F.count("_p").alias("_n"),
        F.sum(F.abs(F.col("_y") - F.col("_p"))).alias("_d"),
        safe_corr("_y", "_p").alias("_corr"),
    )
    corr = F.when(F.col("_n") >= 3, F.col("_corr"))
    return per_cell.agg(
        F.avg(corr).alias("stability_corr"),
        F.avg(corr.isNull().cast("double")).alias("nan_stability"),
        F.try_divide(F.sum("_d").cast("double"), F.sum("_n")).alias("stability_diff"),
    )


def pooled_stability(df: DataFrame, cell: str, bin_col: str, value: str) -> DataFrame:
    """One correlation of (count, previous count) over all cells."""
    order = Window.partitionBy(cell).orderBy(bin_col)
    pairs = df.select(F.col(value).alias("_y"), F.lag(value).over(order).alias("_p"))
    return pairs.agg(safe_corr("_y", "_p").alias("temporal_stability"))


def cell_activity(df: DataFrame, cell: str, value: str) -> DataFrame:
    """Per cell: active bins, median of the non-zero counts, and their product.

    A cell has at most one row per bin, so its exact median is bounded by the calendar.
    """
    pos = F.when(F.col(value) > 0, F.col(value))
    per_cell = df.groupBy(cell).agg(
        F.count(pos).alias("active_bins"), F.percentile(pos, F.lit(0.5)).alias("median_non_zero")
    )
    return per_cell.withColumn("event_intensity", F.col("active_bins") * F.col("median_non_zero"))


def _mean_median(per_cell: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and exact median of a per-cell column, by value histogram."""
    hist = value_histogram(per_cell, column, groups)
    f = F.col("n_rows")
    return hist.groupBy(*groups).agg(
        (F.sum(F.col(column) * f) / F.sum(f)).cast("double").alias(f"{column}_mean"),
        F.percentile(column, F.lit(0.5), f).alias(f"{column}_median"),
    )


def active_bins(df: DataFrame, cell: str, value: str) -> DataFrame:
    return _mean_median(cell_activity(df, cell, value), "active_bins")


def median_non_zero(df: DataFrame, cell: str, value: str) -> DataFrame:
    return _mean_median(cell_activity(df, cell, value), "median_non_zero")


def event_intensity(df: DataFrame, cell: str, value: str) -> DataFrame:
    return _mean_median(cell_activity(df, cell, value), "event_intensity")


# --- all choices at once, sparse ----------------------------------------------------------------


def sparse_counts(
    df: DataFrame, ts: str, cells: dict[int, str], freqs: Sequence[str]
) -> DataFrame:
    """Counts (resolution, freq, cell, time_bin, n) of every choice.

    Events are first counted per (all cells, day) - every bin is a function of the day (or hour) and
    every coarse cell of the fine one - and only these counts are unpivoted.
    """
    fine = "hourly" if any(T.frequency(f).unit == "hour" for f in freqs) else "daily"
    base = (
        df.select(*cells.values(), T.bin_start(ts, fine).alias("_fine"))
        .where(F.col("_fine").isNotNull())
        .groupBy(*cells.values(), "_fine")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    bins = {f: T.bin_start("_fine", f) for f in freqs}
    long = cube.unpivot_cube_keys(base, cells, bins, "_n")
    return long.groupBy("resolution", "freq", "cell", "time_bin").agg(F.sum("_n").alias("n"))


def sweep(counts: DataFrame, min_events: int = 2) -> DataFrame:
    """Every metric of every (resolution, freq) from sparse counts.

    Equals the dense functions on the grid of active cells x observed bins.
    """
    choice = ["resolution", "freq"]
    # The counts feed two branches and the per-cell rows six: each is computed once.
    counts = materialise(counts)
    bin_keys = counts.select("freq", "resolution", "time_bin").distinct()
    by_choice = Window.partitionBy(*choice)
    # One row per choice and bin.
    bins = materialise(bin_keys.select(
        *choice,
        "time_bin",
        F.row_number().over(by_choice.orderBy("time_bin")).alias("i"),
        F.count(F.lit(1)).over(by_choice).alias("b"),
    ))
    by_cell = Window.partitionBy(*choice, "cell")
    in_order = by_cell.orderBy("i")
    rows = (
        counts.join(bins, [*choice, "time_bin"])
        .select(
            *choice,
            "cell",
            "n",
            "i",
            "b",
            F.sum("n").over(by_cell).alias("total"),
            F.lead("i").over(in_order).alias("i_next"),
            F.lead("n").over(in_order).alias("n_next"),
        )
        .where(F.col("total") >= min_events)
    )

    n, i, b = F.col("n").cast("double"), F.col("i"), F.col("b")
    adjacent = F.col("i_next") == i + 1
    n_next = F.col("n_next").cast("double")
    # |change| owned by this row: the step to a neighbour in the next bin, else the fall to zero;
    # plus the rise of the next row out of zero; plus the rise of the first row.
    change = (
        F.when(adjacent, F.abs(n_next - n))
        .when(F.col("i_next").isNotNull(), n + n_next)
        .when(i < b, n)
        .otherwise(F.lit(0.0))
    )
    per_cell = rows.groupBy(*choice, "cell").agg(
        F.max("b").alias("b"),
        F.max("total").alias("total"),
        F.count(F.lit(1)).alias("active_bins"),
        F.percentile("n", F.lit(0.5)).alias("median_non_zero"),
        F.sum(n).alias("s"),
        F.sum(n * n).alias("ss"),
        F.coalesce(F.sum(F.when(adjacent, n * n_next)), F.lit(0.0)).alias("cross"),
        F.coalesce(F.max(F.when(i == 1, n)), F.lit(0.0)).alias("first"),
        F.coalesce(F.max(F.when(i == b, n)), F.lit(0.0)).alias("last"),
        F.sum(change).alias("change"),
        F.min("i").alias("i_first"),
        F.min_by("n", "i").alias("n_first"),
    )
    m = (F.col("b") - 1).cast("double")
    s, ss, first, last = F.col("s"), F.col("ss"), F.col("first"), F.col("last")
    sx, sp = s - first, s - last
    vx = (ss - first * first) - F.try_divide(sx * sx, m)
    vp = (ss - last * last) - F.try_divide(sp * sp, m)
    cov = F.col("cross") - F.try_divide(sx * sp, m)
    tiny = F.lit(1e-9)
    corr = F.when((m >= 3) & (vx > tiny) & (vp > tiny), cov / F.sqrt(vx * vp))
    per_cell = materialise(per_cell.select(
        *choice,
        "cell",
        "b",
        "total",
        "active_bins",
        "median_non_zero",
        (F.col("active_bins") * F.col("median_non_zero")).alias("event_intensity"),
        corr.alias("corr"),
        (F.col("change") + F.when(F.col("i_first") > 1, F.col("n_first")).otherwise(0)).alias("change"),
    ))

    cells_agg = per_cell.groupBy(*choice).agg(
        F.count(F.lit(1)).alias("n_unique_cells"),
        F.max("b").alias("n_bins"),
        F.sum("active_bins").alias("non_zero_rows"),
        F.avg("corr").alias("stability_corr"),
        F.avg(F.col("corr").isNull().cast("double")).alias("nan_stability"),
        F.sum("change").alias("_change"),
        F.avg("total").alias("mean_per_cell"),
    )
    n_cells, n_bins = F.col("n_unique_cells"), F.col("n_bins")
    cells_agg = cells_agg.withColumn(
        "stability_diff", F.try_divide("_change", (n_cells * (n_bins - 1)).cast("double"))
    ).withColumn("zero_rows", n_cells * n_bins - F.col("non_zero_rows"))

    # Value histogram of the dense grid: observed counts plus one row for all the zeros.
    hist = rows.groupBy(*choice, "n").agg(F.count(F.lit(1)).alias("n_rows"))
    zeros = cells_agg.where(F.col("zero_rows") > 0).select(
        *choice, F.lit(0).cast("bigint").alias("n"), F.col("zero_rows").alias("n_rows")
    )
    hist = hist.unionByName(zeros)
    # Distinct counts per choice number at most sqrt(2 x events): a small window.
    before = Window.partitionBy(*choice).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    moments = ranked.groupBy(*choice).agg(*_moment_aggs("n", "n_rows"), _rank_sum("n").alias("_w"))
    stats = _from_moments(
        moments, [*choice, (2 * F.col("_w") / (F.col("rows") * F.col("_s1")) - (F.col("rows") + 1) / F.col("rows")).alias("gini")]
    )

    # Mean and exact median over the cells of three per-cell columns, from one value histogram.
    measures = ("active_bins", "median_non_zero", "event_intensity")
    items = F.array(
        *[F.named_struct(F.lit("m"), F.lit(m), F.lit("v"), F.col(m).cast("double")) for m in measures]
    )
    values = per_cell.select(*choice, F.explode(items).alias("_i")).groupBy(*choice, "_i.m", "_i.v").agg(
        F.count(F.lit(1)).alias("f")
    )
    v, f = F.col("v"), F.col("f")
    centres = values.groupBy(*choice, "m").agg(
        (F.sum(v * f) / F.sum(f)).alias("mean"), F.percentile("v", F.lit(0.5), f).alias("median")
    )
    per_choice = centres.groupBy(*choice).agg(
        *[
            F.max(F.when(F.col("m") == m, F.col(c))).alias(f"{m}_{c}")
            for m in measures
            for c in ("mean", "median")
        ]
    )
    cells_agg = cells_agg.drop("_change", "zero_rows", "non_zero_rows", "n_bins")
    return stats.join(cells_agg, choice).join(per_choice, choice)


def normalise(column: Column, window: Window) -> Column:
    lo, hi = F.min(column).over(window), F.max(column).over(window)
    return (column - lo) / (hi - lo + F.lit(NORM_EPSILON))


def composite_scores(results: DataFrame) -> DataFrame:
    """Min-max normalised metrics and the three scores (one row per choice: a small table)."""
    everything = Window.partitionBy()
    cleaned = results.withColumns(
        {
            "stability_corr": F.greatest(F.coalesce("stability_corr", F.lit(0.0)), F.lit(0.0)),
            "stability_diff": F.coalesce("stability_diff", F.lit(0.0)),
        }
    )
    normed = {
        "entropy": "entropy",
        "non_zero_share": "non_zero_share",
        "var": "var",
        "stability_corr": "stability_corr",
        "stability_diff": "stability_diff",
        "active_bins_median": "active_bins_median",
        "median_non_zero_median": "median_non_zero_median",
    }
    out = cleaned.withColumns(
        {f"{k}_norm": normalise(F.col(c).cast("double"), everything) for k, c in normed.items()}
    )

    def weighted(stability: str) -> Column:
        w = SCORE_WEIGHTS
        return (
            F.lit(w["entropy"]) * F.col("entropy_norm")
            + F.lit(w["non_zero_share"]) * F.col("non_zero_share_norm")
            + F.lit(w["var"]) * F.col("var_norm")
            + F.lit(w["stability"]) * F.col(f"{stability}_norm")
        )

    final = reduce(
        lambda a, b: a + b, [F.lit(w) * F.col(f"{c}_norm") for c, w in FINAL_WEIGHTS.items()]
    )
    return out.withColumns(
        {
            "score_diff": weighted("stability_diff"),
            "score_corr": weighted("stability_corr"),
            "score": final,
        }
    )


def usable(results: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    return results.where((F.col("non_zero_share") > MIN_NON_ZERO_SHARE) & (F.col("rows") > min_rows))


def best_choices(results: DataFrame, top: int = TOP_CHOICES, min_rows: int = MIN_ROWS) -> DataFrame:
    """Usable choices by score, best first."""
    scored = composite_scores(usable(results, min_rows))
    return scored.orderBy(F.desc("score"), "resolution", "freq").limit(top)


# --- describing arbitrary columns ---------------------------------------------------------------

# Reported quantiles of the feature description.
DESCRIBE_QUANTILES = {
    "q01": 0.01,
    "q05": 0.05,
    "q10": 0.10,
    "q25": 0.25,
    "median": 0.5,
    "q75": 0.75,
    "q90": 0.9,
    "q95": 0.95,
    "q99": 0.99,
}


def long_values(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """Rows (column, value) of several columns, nulls included."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, value {as_type}")
    items = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns]
    )
    return df.select(F.explode(items).alias("_i")).select("_i.column", "_i.value")


def quantile_table(df: DataFrame, columns: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """One row per column with the named exact quantiles; no value map is built in one task."""
    found = wide_quantiles(df, columns, list(quantiles.values()))
    return found.groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for name, p in quantiles.items()
        ]
    )


def summary_table(df: DataFrame, columns: Sequence[str], quantiles: dict[str, float], facts: Callable[[str], list[Column]]) -> DataFrame:
    """One row per column: ``facts`` (aggregates of it, all from one scan) and its quantiles; none for a frame without rows."""
    if not columns:  # no rows, but the same fields
        nothing = df.limit(0).select(F.lit(None).cast("double").alias("_none"))
        return summary_table(nothing, ["_none"], quantiles, facts)
    entries = [F.struct(F.lit(c).alias("column"), *facts(c)) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*entries).alias("_m")).where("_rows > 0")
    return row.select(F.inline("_m")).join(quantile_table(df, columns, quantiles), "column", "left")


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, range, quantiles and population moments of each column, one row per column.

    NaN counts as missing.  All moments come from one aggregate over the table.
    """
    columns = list(columns)
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])

    def moments(c: str) -> list[Column]:
        v = F.col(c)
        spread = F.stddev_pop(v)
        return [
            F.count(v).alias("count_clean"),
            F.count_if(v.isNull()).alias("nan_count"),
            F.min(v).alias("min"),
            F.avg(v).alias("mean"),
            F.max(v).alias("max"),
            spread.alias("std"),
            F.when(spread > 0, F.skewness(v)).alias("skewness"),
            F.when(spread > 0, F.kurtosis(v)).alias("kurtosis"),
        ]

    return summary_table(numbers, columns, DESCRIBE_QUANTILES, moments)


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, nulls, and the most frequent value (smallest on ties) of each column."""
    counts = (
        long_values(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.col("value").isNotNull()
    # max over (n, value descending) cannot be said for text; take the largest n, then the
    # smallest value among the rows that reach it.
    peak = counts.where(known).groupBy("column").agg(F.max("n").alias("top_freq"))
    top = (
        counts.where(known)
        .join(F.broadcast(peak), "column")
        .where(F.col("n") == F.col("top_freq"))
        .groupBy("column")
        .agg(F.min("value").alias("top"), F.max("top_freq").alias("top_freq"))
    )
    sizes = counts.groupBy("column").agg(
        F.count_if(known).alias("n_unique"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("nan_count"),
    )
    return sizes.join(top, "column", "left")
