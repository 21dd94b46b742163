"""Schema harmonisation, typing and cleaning actions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.session import materialise

log = logging.getLogger(__name__)

# Overseas departments, accepted years, texts that mean null.
OVERSEAS_DEPARTMENTS = ("971", "972", "973", "974", "975", "976", "977", "978", "986", "987", "988")
TAGGED_DEPARTMENTS = ("971", "972", "973", "974", "976")
YEAR_RANGE = (2000, 2035)
NULL_TEXTS = ("", "nan")


# --- schema -------------------------------------------------------------------------------------


def rename_merging(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Rename; when several old names share a new one, the first non-null value wins."""
    sources: dict[str, list[str]] = {}
    for c in df.columns:
        sources.setdefault(rename.get(c, c), []).append(c)
    return df.select(
        *[(F.col(s[0]) if len(s) == 1 else F.coalesce(*s)).alias(new) for new, s in sources.items()]
    )


def harmonise(
    frames: dict[int, DataFrame],
    rename: dict[str, str],
    drop: Sequence[str] = (),
    required: Sequence[str] = (),
    start_year: int = 1900,
    year_col: str = "source_year",
) -> DataFrame:
    """One table of all yearly frames: renamed, union of columns, missing ones null, sorted names."""
    kept = {y: f for y, f in frames.items() if y >= start_year}
    ready = [
        rename_merging(f.drop(*drop), rename).withColumn(year_col, F.lit(y)) for y, f in kept.items()
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready)
    for c in required:
        name = rename.get(c, c)
        if name not in union.columns:
            union = union.withColumn(name, F.lit(None).cast("string"))
    return union.select(*sorted(union.columns))


def required_columns(findings: DataFrame) -> DataFrame:
    """Key, time and place columns named by earlier findings."""
    roles = ["primary_key", "datetime", "geo"]
    return findings.where(F.col("role").isin(roles)).select("role", "column").distinct()


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def cut_names(df: DataFrame, separator: str) -> DataFrame:
    """Column names up to the first separator."""
    return df.toDF(*[c.split(separator)[0] for c in df.columns])


# --- types --------------------------------------------------------------------------------------


def to_number(c: str) -> Column:
    """Number of a text that may carry a decimal comma; anything else is null."""
    return F.regexp_replace(F.trim(F.col(c).cast("string")), ",", ".").try_cast("double")


def adapt_types(
    df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()
) -> DataFrame:
    """Numbers by coercion, categories as text, in one projection.

    With neither list every text column whose non-null values are all numbers becomes numeric
    (one aggregate decides for all columns).
    """
    if not numeric and not categorical:
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if not texts:
            return df
        bad = df.agg(
            *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]
        ).first()
        numeric = [c for c in texts if bad[c] == 0]
    num, cat = set(numeric), set(categorical)
    return df.select(
        *[
            F.col(c).try_cast("double").alias(c) if c in num else F.col(c).cast("string").alias(c) if c in cat else F.col(c)
            for c in df.columns
        ]
    )


def normalise_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Round half to even; text that is no number becomes null."""
    return df.withColumns(
        {c: F.bround(F.col(c).try_cast("double"), 0).cast("bigint") for c in columns if c in df.columns}
    )


def clean_codes(df: DataFrame, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Trimmed texts, null words to null, decimal comma to point, and numbers where asked."""

    def fix(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        text = F.when(~F.lower(text).isin(*NULL_TEXTS), F.regexp_replace(text, ",", "."))
        return text.try_cast("double") if c in numeric else text

    return df.withColumns({c: fix(c) for c in columns})


def parse_list(c: str) -> Column:
    """``[..]`` literal or comma-separated text to an array of texts; anything else is empty."""
    text = F.col(c)
    literal = F.from_json(text, "array<string>")
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.when(text.startswith("[") & text.endswith("]"), literal).when(text.contains(","), items)
    return F.coalesce(parsed, F.array().cast("array<string>"))


# --- rows ---------------------------------------------------------------------------------------


def drop_duplicates(
    df: DataFrame, subset: Sequence[str] = (), keep: str = "first", order_by: str | None = None
) -> DataFrame:
    """First or last row per subset in the order of ``order_by``; whole-row duplicates without a subset.

    Rows without an order value come after those with one, whichever end is kept, and rows alike in it are told apart
    by their other columns. ``keep="last"`` needs an order. The kept row is found by an aggregate with partial results,
    not by sorting a possibly hot group.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep!r}")
    if order_by is None and keep == "last":
        raise ValueError("keep='last' needs order_by")
    if not subset:
        return df.dropDuplicates()
    if order_by is None:
        return df.dropDuplicates(list(subset))
    at = F.col(order_by)
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    if keep == "first":
        pick = F.min_by(F.struct(*df.columns), F.struct(at.isNull(), at, tie))
    else:
        pick = F.max_by(F.struct(*df.columns), F.struct(at.isNotNull(), at, tie))
    return (
        df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(subset)])
        .agg(pick.alias("_row"))
        .select("_row.*")
    )


def parse_datetimes(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = ()) -> DataFrame:
    """Timestamps by the first fitting format; what fits none is null."""

    def parse(c: str) -> Column:
        text = F.col(c).cast("string")
        tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats] or [F.try_to_timestamp(text)]
        return F.coalesce(*tries).cast("timestamp_ntz")

    return df.withColumns({c: parse(c) for c in columns if c in df.columns})


def _mode(df: DataFrame, c: str) -> Column:
    """Most frequent value, the smallest on ties, as a scalar."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), c).limit(1).select(c).scalar()


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Exact medians of all columns from one run, as scalars."""
    from hexcadence.operators.resolution import quantile_table

    if not columns:
        return {}
    found = materialise(quantile_table(df, columns, {"median": 0.5}))  # a row per column
    return {c: found.where(F.col("column") == c).select("median").scalar() for c in columns}


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """Fill nulls: numbers by median, mean or zero; texts by mode (or "0" for zero)."""
    fills = {}
    numbers = [c for c in dict.fromkeys(columns) if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)]
    medians = _medians(df, numbers) if strategy == "median" else {}
    for c in columns:
        if c not in df.columns:
            continue
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        if strategy == "zero":
            fill = F.lit(0) if numeric else F.lit("0")
        elif not numeric:
            fill = _mode(df, c)
        elif strategy == "median":
            fill = medians[c]
        elif strategy == "mean":
            fill = df.select(F.avg(c)).scalar()
        else:  # mode is defined for texts only
            continue
        fills[c] = F.coalesce(F.col(c), fill)
    return df.withColumns(fills)


def add_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``scaled_<c>``: distance from the mean in sample standard deviations."""
    present = [c for c in columns if c in df.columns]
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in present], *[F.stddev_samp(c).alias(f"s_{c}") for c in present])
    return df.withColumns(
        {
            f"scaled_{c}": F.try_divide(
                F.col(c) - stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar()
            )
            for c in present
        }
    )


def add_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``log_<c>``: log1p of the value clipped at zero."""
    return df.withColumns(
        {
            f"log_{c}": F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))))
            for c in columns
            if c in df.columns
        }
    )


def exclude_regions(
    df: DataFrame, region: str, excluded: Sequence[str] = OVERSEAS_DEPARTMENTS
) -> DataFrame:
    """Without the listed regions; rows with an unknown region stay."""
    return df.where(~F.coalesce(F.col(region).cast("string").isin(list(excluded)), F.lit(False)))


def tag_regions(df: DataFrame, region: str, excluded: Sequence[str] = TAGGED_DEPARTMENTS) -> DataFrame:
    listed = F.col(region).cast("string").isin(list(excluded))
    return df.withColumn("region_group", F.when(listed, "dom").otherwise("metropole"))


def repair_year(df: DataFrame, year: str) -> DataFrame:
    """Two-digit years are of this century; years outside the range are flagged."""
    fixed = F.when(F.col(year) < 100, F.col(year) + 2000).otherwise(F.col(year))
    return df.withColumn(year, fixed).withColumn("year_valid", F.col(year).between(*YEAR_RANGE))


def clip_upper(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Cap columns; nulls stay null."""
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(v).cast(df.schema[c].dataType)))
            for c, v in limits.items()
        }
    )


# --- action plan --------------------------------------------------------------------------------

Action = dict


@dataclass(frozen=True)
class Step:
    """One typed cleaning step: its columns, and the parameters that its kind reads."""

    target: tuple[str, ...] = ()
    subset: tuple[str, ...] = ()
    keep: str = "first"
    order_by: str | None = None
    formats: tuple[str, ...] = ()
    strategy: str = "median"

    @classmethod
    def of(cls, action: Action) -> Step:
        """From a plan's entry; parameters that are missing or null keep their defaults."""
        known = {f.name: f.type for f in fields(cls)}
        given = {"target": action.get("target"), **(action.get("params") or {})}
        unknown = set(given) - set(known)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)} of {action['action']}")
        lists = {"target", "subset", "formats"}
        return cls(**{k: tuple(v) if k in lists else v for k, v in given.items() if v is not None})


# The names of the actions.
ACTIONS: dict[str, Callable[[DataFrame, Step], DataFrame]] = {
    "drop_duplicates": lambda df, s: drop_duplicates(df, s.subset, s.keep, s.order_by),
    "parse_datetime": lambda df, s: parse_datetimes(df, s.target, s.formats),
    "impute_nan": lambda df, s: impute(df, s.target, s.strategy),
    "handle_skewness": lambda df, s: add_scaled(df, s.target),
    "handle_kurtosis": lambda df, s: add_log(df, s.target),
}


def apply_plan(df: DataFrame, plan: Sequence[Action]) -> DataFrame:
    """Fold the actions over the table in order; unknown ones are logged and left out."""
    for action in plan:
        handler = ACTIONS.get(action["action"])
        if handler is None:
            log.warning("no handler for action %s", action["action"])
            continue
        df = handler(df, Step.of(action))
    return df
