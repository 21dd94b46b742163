"""Data-quality checks.  Each returns a small table of findings, computed in one pass where possible."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.functions.stats import ratio, unbiased_kurtosis, unbiased_skewness
from hexcadence.operators.resolution import long_values, summary_table
from hexcadence.operators.timebin import time_gaps

# Thresholds and the accepted date formats.
MISSING_THRESHOLD = 0.5
DUPLICATE_THRESHOLD = 0.01
ZERO_THRESHOLD = 0.8
SKEW_LIMIT, KURTOSIS_LIMIT = 2.0, 10.0
HIGH_CARDINALITY, TOP_VALUES = 50, 10
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss")
DATE_SUCCESS = 0.8
# Column names that hold a part of a date, in English, French and German.
SPLIT_DATE_NAMES = (
    "year", "yr", "month", "day", "hour", "minute", "second", "sec", "hrmn",
    "an", "mois", "jour", "heure", "seconde",
    "jahr", "monat", "tag", "stunde", "sekunde",
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _per_column(df: DataFrame, fields: dict[str, dict[str, Column]], metrics: str = "") -> DataFrame:
    """One aggregate over the table, shown as one row per column.

    ``metrics`` is the schema of the metrics for tables that have no such column.
    """
    if not fields:
        return df.sparkSession.createDataFrame([], f"column string, {metrics}")
    rows = F.array(
        *[
            F.named_struct(F.lit("column"), F.lit(c), *[x for k, v in f.items() for x in (F.lit(k), v)])
            for c, f in fields.items()
        ]
    )
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def overview(df: DataFrame) -> DataFrame:
    """Column names and types with the table's row and column counts."""
    fields = {
        f.name: {
            "position": F.lit(i),
            "dtype": F.lit(f.dataType.simpleString()),
            "n_rows": F.count(F.lit(1)),
            "n_columns": F.lit(len(df.columns)),
        }
        for i, f in enumerate(df.schema)
    }
    return _per_column(df, fields)


def missing_analysis(df: DataFrame, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    fields = {
        c: {"nan_count": F.count_if(is_missing(df, c)), "n_rows": F.count(F.lit(1))} for c in df.columns
    }
    out = _per_column(df, fields).withColumn("nan_ratio", ratio(F.col("nan_count"), F.col("n_rows")))
    return out.withColumn("flagged", F.coalesce(F.col("nan_ratio") > threshold, F.lit(False))).orderBy(
        F.desc("nan_count"), "column"
    )


def infinite_analysis(df: DataFrame) -> DataFrame:
    inf = F.lit(float("inf"))
    fields = {
        c: {"inf_count": F.count_if(F.abs(F.col(c).cast("double")) == inf)} for c in numeric_columns(df)
    }
    return _per_column(df, fields, "inf_count bigint").withColumn("flagged", F.col("inf_count") > 0)


def duplicate_analysis(
    df: DataFrame, grouping: Sequence[str] = (), threshold: float = DUPLICATE_THRESHOLD
) -> DataFrame:
    """Rows equal to an earlier one, over all columns and optionally over ``grouping``."""

    def count(scope: str, keys: Sequence[str]) -> DataFrame:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(
            F.lit(scope).alias("scope"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        )

    out = count("general", df.columns)
    if grouping:
        out = out.unionByName(count("grouped", grouping))
    out = out.withColumn("duplicate_ratio", ratio(F.col("n_duplicates"), F.col("n_rows")))
    return out.withColumn("flagged", F.coalesce(F.col("duplicate_ratio") > threshold, F.lit(False)))


def numeric_summary(
    df: DataFrame, quantiles: dict[str, float], columns: Sequence[str] | None = None
) -> DataFrame:
    """Describe with exact quantiles and bias-corrected skewness and kurtosis, and their flags."""
    columns = list(columns or numeric_columns(df))
    clean = df.select(
        *[F.when(~is_missing(df, c), F.col(c).cast("double")).alias(c) for c in columns]
    )

    def moments(c: str) -> list[Column]:
        v = F.col(c)
        return [
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            unbiased_skewness(v).alias("skewness"),
            unbiased_kurtosis(v).alias("kurtosis"),
        ]

    out = summary_table(clean, columns, quantiles, moments).where(F.col("count") > 0)
    return out.withColumns(
        {
            "skew_flag": F.coalesce(F.abs("skewness") > SKEW_LIMIT, F.lit(False)),
            "kurtosis_flag": F.coalesce(F.col("kurtosis") > KURTOSIS_LIMIT, F.lit(False)),
        }
    )


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = long_values(df, columns, "string").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: int = HIGH_CARDINALITY
) -> DataFrame:
    counts = _value_counts(df, list(columns or text_columns(df)))
    return (
        counts.groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_unique"))
        .withColumn("high_cardinality", F.col("n_unique") >= threshold)
    )


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = TOP_VALUES, least: bool = False
) -> DataFrame:
    """Most (or least) frequent values per column with their share of the non-null rows.

    ``row_number() <= n`` is planned as a limit inside every task before the shuffle.
    """
    columns = list(columns or text_columns(df))
    counts = _value_counts(df, columns)
    order = F.col("n").asc() if least else F.col("n").desc()
    w = Window.partitionBy("column").orderBy(order, "value")
    top = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    sizes = _per_column(df, {c: {"_total": F.count(c)} for c in columns}, "_total bigint")
    return (
        top.join(F.broadcast(sizes), "column")  # one row per column
        .withColumn("share", ratio(F.col("n"), F.col("_total")))
        .drop("_total")
    )


def split_date_columns(columns: Sequence[str]) -> list[str]:
    """Columns that already are parts of a date; meaningful when there are two or more."""
    return [c for c in columns if c.lower() in SPLIT_DATE_NAMES]


def datetime_candidates(df: DataFrame, order_by: str, sample: int = 100) -> DataFrame:
    """Text columns that look like dates: by name, or by parsing the first non-null values.

    Per column the best of the known formats is reported.
    """
    texts = text_columns(df)
    if not texts:
        empty = "column string, success_ratio double, by_name boolean, candidate boolean"
        return df.sparkSession.createDataFrame([], empty)
    # A bounded heap per task and column; nothing is sorted as a whole.
    first = reduce(
        DataFrame.unionByName,
        [
            df.where(F.col(c).isNotNull())
            .orderBy(order_by, c)
            .limit(sample)
            .select(F.lit(c).alias("column"), F.col(c).alias("value"))
            for c in texts
        ],
    )
    rates = [F.avg(F.try_to_timestamp("value", F.lit(f)).isNotNull().cast("double")) for f in DATE_FORMATS]
    tested = first.groupBy("column").agg(F.greatest(*rates).alias("success_ratio"))
    by_name = F.lower("column").contains("date")
    return tested.withColumns(
        {"by_name": by_name, "candidate": by_name | (F.col("success_ratio") > DATE_SUCCESS)}
    )


def zero_inflation(df: DataFrame, threshold: float = ZERO_THRESHOLD) -> DataFrame:
    fields = {
        c: {"zero_ratio": F.avg(F.coalesce(F.col(c) == 0, F.lit(False)).cast("double"))}
        for c in numeric_columns(df)
    }
    found = _per_column(df, fields, "zero_ratio double")
    return found.withColumn("flagged", F.coalesce(F.col("zero_ratio") > threshold, F.lit(False)))


def null_ratio(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_missing(df, column)).alias("n_null"),
        F.avg(is_missing(df, column).cast("double")).alias("null_ratio"),
    )


def aggregate_consistency(
    df: DataFrame, group: str, metric: str, stored: DataFrame, stored_value: str, tolerance: float = 0.01
) -> DataFrame:
    """Recomputed sum per group against a stored value; a relative difference above tolerance violates."""
    sums = df.groupBy(group).agg(F.sum(metric).alias("computed_value"))
    both = sums.join(stored.select(group, F.col(stored_value).alias("stored_value")), group)
    diff = F.col("computed_value") - F.col("stored_value")
    return both.withColumns(
        {"difference": diff, "relative_diff": F.try_divide(diff, F.col("stored_value"))}
    ).withColumn("violation", F.coalesce(F.abs("relative_diff") > tolerance, F.lit(False)))


def zscores(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Z-score per row and an outlier flag; null scores when the column does not vary."""
    stats = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    mean, std = stats.select("m").scalar(), stats.select("s").scalar()
    z = F.try_divide(F.col(column) - mean, std)
    return df.withColumn("z_score", z).withColumn(
        "outlier", F.coalesce(F.abs("z_score") >= threshold, F.lit(False))
    )


def time_integrity(df: DataFrame, ts: str, freq: str) -> DataFrame:
    """Missing bins as one finding: how many, the first and the last."""
    gaps = time_gaps(df, ts, freq)
    return gaps.agg(
        F.lit("time_gaps").alias("check"),
        F.lit("missing_time_periods").alias("issue_type"),
        F.count(F.lit(1)).cast("double").alias("value"),
        F.min("missing_bin").alias("first_missing"),
        F.max("missing_bin").alias("last_missing"),
    )


def range_assertions(
    df: DataFrame,
    *,
    min_rows: int = 500_000,
    min_geo_ratio: float = 0.45,
    lat: str = "latitude",
    lon: str = "longitude",
    ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Pass/fail rows for row count, geo share and calendar ranges, from one aggregate."""
    # Accepted calendar ranges.
    ranges = ranges or {"year": (2001, 2035), "hour": (0, 24), "month": (1, 12)}
    geo = F.avg((F.col(lat).isNotNull() & F.col(lon).isNotNull()).cast("double"))
    rows = [
        ("row_count", F.count(F.lit(1)).cast("double"), F.count(F.lit(1)) >= min_rows),
        ("geo_ratio", geo, geo >= min_geo_ratio),
    ]
    for c, (lo, hi) in ranges.items():
        rows.append((f"min_{c}", F.min(c).cast("double"), F.min(c) >= lo))
        rows.append((f"max_{c}", F.max(c).cast("double"), F.max(c) <= hi))
    table = F.array(
        *[
            F.named_struct(
                F.lit("check"), F.lit(n), F.lit("value"), v, F.lit("passed"), F.coalesce(ok, F.lit(False))
            )
            for n, v, ok in rows
        ]
    )
    return df.agg(table.alias("_rows")).select(F.inline("_rows"))


def sql_type(dtype: T.DataType) -> str:
    """Target column type of a table definition."""
    if isinstance(dtype, T.IntegralType):
        return "BIGINT" if isinstance(dtype, T.LongType) else "INTEGER"
    if isinstance(dtype, (T.FractionalType,)):
        return "DOUBLE PRECISION"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.DateType):
        return "DATE"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return "VARCHAR(255)"


def target_schema(df: DataFrame, primary_key: str | None = None) -> dict[str, str]:
    """Proposed table definition of a frame."""
    out = {f.name: sql_type(f.dataType) for f in df.schema}
    if primary_key in out:
        out[primary_key] += " PRIMARY KEY"
    return out


