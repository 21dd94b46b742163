"""Run quality checks over tables, collect findings, and turn them into cleaning actions.

A check is a function ``table -> findings (check, column, metric, value, flagged)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcadence.operators import geo, quality

CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {}
CATEGORIES: dict[str, list[str]] = {"tabular": [], "geo": []}

# Which action answers which flagged check.
ACTION_OF_CHECK = {
    "missing": "impute_nan",
    "infinite": "impute_inf",
    "zero_inflation": "handle_zero_inflation",
    "duplicates": "drop_duplicates",
    "skewness": "handle_skewness",
    "kurtosis": "handle_kurtosis",
    "cardinality": "cardinality_action",
    "geo_duplicates": "drop_geo_duplicates",
    "datetime": "parse_datetime",
}


def check(name: str, category: str = "tabular"):
    """Register a check under a category."""

    def wrap(fn):
        CHECKS[name] = fn
        CATEGORIES.setdefault(category, []).append(name)
        return fn

    return wrap


def _finding(df: DataFrame, name: str, metric: str, flag: str = "flagged", column: str = "column") -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        F.col(column).alias("column"),
        F.lit(metric).alias("metric"),
        F.col(metric).cast("double").alias("value"),
        F.col(flag).alias("flagged"),
    )


@check("missing")
def _missing(df):
    return _finding(quality.missing_analysis(df), "missing", "nan_ratio")


@check("infinite")
def _infinite(df):
    return _finding(quality.infinite_analysis(df), "infinite", "inf_count")


@check("zero_inflation")
def _zero(df):
    return _finding(quality.zero_inflation(df), "zero_inflation", "zero_ratio")


@check("duplicates")
def _duplicates(df):
    found = quality.duplicate_analysis(df).withColumn("column", F.lit("all"))
    return _finding(found, "duplicates", "duplicate_ratio")


@check("cardinality")
def _cardinality(df):
    return _finding(quality.categorical_summary(df), "cardinality", "n_unique", "high_cardinality")


@check("skewness")
def _skewness(df):
    return _finding(quality.numeric_summary(df, {"median": 0.5}), "skewness", "skewness", "skew_flag")


@check("kurtosis")
def _kurtosis(df):
    return _finding(quality.numeric_summary(df, {"median": 0.5}), "kurtosis", "kurtosis", "kurtosis_flag")


@check("geo_duplicates", "geo")
def _geo_duplicates(df):
    named = geo.detect_geo_columns(df.columns)
    pairs = [(la, lo) for la in named["lat"] for lo in named["lon"]]
    found = [
        geo.duplicate_coordinates(df, la, lo).withColumns(
            {"column": F.lit(f"{la},{lo}"), "flagged": F.col("n_duplicates") > 0}
        )
        for la, lo in pairs
    ]
    if not found:
        empty = "check string, column string, metric string, value double, flagged boolean"
        return df.sparkSession.createDataFrame([], empty)
    return _finding(reduce(DataFrame.unionByName, found), "geo_duplicates", "duplicate_ratio")


def default_checks(structure: dict[str, bool]) -> list[str]:
    """Checks by what a dataset holds: ``{"table": True, "geo_data": True}``."""
    names = []
    if structure.get("table"):
        names += CATEGORIES["tabular"]
    if structure.get("geo_data"):
        names += CATEGORIES["geo"]
    return names


def run_checks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Findings of the named checks as one table."""
    return reduce(DataFrame.unionByName, [CHECKS[n](df) for n in names])


def run_all(tables: dict[str, DataFrame], structure: dict[str, bool]) -> DataFrame:
    """Findings of the default checks over several tables."""
    names = default_checks(structure)
    parts = [run_checks(df, names).withColumn("table", F.lit(t)) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def recommend(findings: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep, action, column) answering the flagged findings."""
    action = F.create_map(*[F.lit(x) for kv in ACTION_OF_CHECK.items() for x in kv])
    return findings.where("flagged").select(*keep, action[F.col("check")].alias("action"), "column")


def as_plan(actions: DataFrame, params: dict[str, dict] | None = None) -> list[dict]:
    """Action list for ``clean.apply_plan``; at most one row per action and column is read."""
    params = params or {}
    plan: dict[str, list[str]] = {}
    for row in actions.distinct().orderBy("action", "column").collect():
        plan.setdefault(row["action"], []).append(row["column"])
    return [{"action": a, "target": t, "params": params.get(a, {})} for a, t in plan.items()]
