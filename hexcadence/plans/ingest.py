"""Yearly raw files -> one harmonised, cleaned and validated table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hexcadence.operators import clean
from hexcadence.plans import audit
from hexcadence.sources import tables


def harmonised_and_clean(
    frames: dict[int, DataFrame],
    *,
    rename: dict[str, str],
    drop: Sequence[str] = (),
    required: Sequence[str] = (),
    start_year: int = 1900,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    integers: Sequence[str] = (),
    plan: Sequence[dict] = (),
) -> DataFrame:
    """Union of the years under one schema, typed, with the cleaning actions applied in order."""
    union = clean.harmonise(frames, rename, drop, required, start_year)
    typed = clean.normalise_integers(clean.adapt_types(union, numeric, categorical), integers)
    return clean.apply_plan(typed, plan)


def planned_actions(df: DataFrame, params: dict[str, dict] | None = None) -> list[dict]:
    """Cleaning actions answering what the default checks find in a table."""
    findings = audit.run_checks(df, audit.default_checks({"table": True}))
    return audit.as_plan(audit.recommend(findings), params)


def load(df: DataFrame, name: str, dtypes: dict[str, str], key: str, replace: bool = True) -> DataFrame:
    """Write the table and return its key validation."""
    return tables.save_table(df, name, dtypes=dtypes, key=key, replace=replace)
