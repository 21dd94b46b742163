"""Time operators on tables: timestamps from parts, part columns, bins, calendars, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcadence.functions import timefn as T


def with_clock(df: DataFrame, text: str, out: str = "time_clean") -> DataFrame:
    return df.withColumn(out, T.parse_hhmm(text))


def with_timestamp(
    df: DataFrame,
    *,
    id_col: str | None = None,
    year: str = "year",
    month: str = "month",
    day: str = "day",
    time_text: str = "hr_min",
    out: str = "datetime",
) -> DataFrame:
    """Timestamp from date parts and clock text; the year may come from the first id digits."""
    year_col = (
        F.substring(F.col(id_col).cast("string"), 1, 4).try_cast("int") if id_col else F.col(year)
    )
    parsed = df.withColumn("time_clean", T.parse_hhmm(time_text))
    return parsed.withColumn(
        out,
        T.make_timestamp(
            year_col, month, day, T.clock_part("time_clean", "hour"), T.clock_part("time_clean", "minute")
        ),
    )


def with_time_parts(df: DataFrame, ts: str, parts: Sequence[str]) -> DataFrame:
    """Add the named parts; ``is_weekend`` needs no weekday column beside it, unknown names are skipped."""
    cols = {p: T.time_part(ts, p) for p in parts if p in T.TIME_PARTS}
    if "is_weekend" in parts:
        cols["is_weekend"] = F.weekday(ts) >= 5
    return df.withColumns(cols)


def with_cyclic(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Sine and cosine columns for part columns that exist and have a known cycle."""
    cols = {}
    for p in parts:
        if p in T.CYCLE_LENGTH and p in df.columns:
            cols[f"{p}_sin"], cols[f"{p}_cos"] = T.cyclic(p, p)
    return df.withColumns(cols)


def with_bin_cycle(df: DataFrame, bin_col: str, freq: str) -> DataFrame:
    """Cyclic features fitting the bin width: month and weekday below a month, else month."""
    code = T.frequency(freq).code
    parts = ["month", "weekday"] if code in ("W", "2W") else ["month"]
    return with_cyclic(with_time_parts(df, bin_col, parts), parts)


def with_bin(df: DataFrame, ts: str, freq: str, out: str = "time_bin") -> DataFrame:
    return df.withColumn(out, T.bin_start(ts, freq))


def with_n_weekly(df: DataFrame, ts: str, weeks: int = 2) -> DataFrame:
    return df.withColumn(f"{T.N_WEEK_NAMES[weeks]}_weekly", T.n_week_start(ts, weeks))


def with_rush_hour(df: DataFrame, hour: str, out: str = "is_rush_hour") -> DataFrame:
    return df.withColumn(out, T.is_rush_hour(hour))


def time_limits(df: DataFrame, ts: str) -> DataFrame:
    """One row: January 1 of the first year to the last second of the last year."""
    span = df.agg(F.min(F.year(ts)).alias("lo"), F.max(F.year(ts)).alias("hi"))
    return span.select(
        F.make_timestamp_ntz("lo", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("lower"),
        F.make_timestamp_ntz("hi", F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59)).alias("upper"),
    )


def calendar(limits: DataFrame, freq: str, out: str = "time_bin") -> DataFrame:
    """All bins inside one-row limits: Mondays, every n-th Monday, month starts or ends, days, hours."""
    f = T.frequency(freq)
    lo, hi = F.col("lower"), F.col("upper")
    if f.unit == "week":
        day = lo.cast("date")
        start = F.date_add(day, (F.lit(7) - F.weekday(day)) % F.lit(7)).cast("timestamp_ntz")
    elif f.unit == "month":
        first = F.trunc(lo.cast("date"), "MM").cast("timestamp_ntz")
        start = F.when(first >= lo, first).otherwise(first + F.expr("interval 1 month"))
    else:
        base = T.bin_start("lower", f)
        start = F.when(base >= lo, base).otherwise(base + f.step)
    bins = limits.where(start <= hi).select(F.explode(F.sequence(start, hi, f.step)).alias(out))
    if f.code == "ME":
        return bins.select(F.last_day(F.col(out).cast("date")).cast("timestamp_ntz").alias(out))
    return bins


def time_gaps(df: DataFrame, ts: str, freq: str, out: str = "missing_bin") -> DataFrame:
    """Bins between the first and the last observed one that hold no row."""
    f = T.frequency(freq)
    seen = df.select(T.bin_start(ts, f).alias(out)).where(F.col(out).isNotNull()).distinct()
    span = seen.agg(F.min(out).alias("lo"), F.max(out).alias("hi")).where(F.col("lo").isNotNull())
    expected = span.select(F.explode(F.sequence("lo", "hi", f.step)).alias(out))
    return expected.join(seen, out, "left_anti")
