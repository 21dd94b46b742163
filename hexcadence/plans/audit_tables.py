"""Audit of several tables: scalar checks share one scan of a table, the others run after the facts they need.

A check is *scalar* (aggregates over a table's rows), of a *table* (needs a grouping of its own) or *cross* (compares
tables). All scalar checks of a table ride as observed metrics on the scan that groups whole rows for the duplicates
check. What a check needs is declared; the order follows from that, and checks between tables mostly use facts that the
scans have already given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.functions.stats import unbiased_kurtosis, unbiased_skewness
from hexcadence.operators import geo, merging, quality

FINDINGS = "table string, other string, check string, column string, metric string, value double, flagged boolean"

Facts = dict[tuple[str, str, str], dict]  # (table, check, column) -> parts that a scan gave


@dataclass(frozen=True)
class Check:
    """``parts`` gives the aggregates of a scalar check by column, ``run`` the values of any other check.

    ``value`` makes a scalar check's number from its parts and the table's number of rows; ``bad`` flags it.
    """

    name: str
    kind: str
    metric: str
    bad: Callable[[float], bool]
    needs: tuple[str, ...] = ()
    parts: Callable[[DataFrame], dict[str, dict[str, Column]]] | None = None
    value: Callable[[dict, int], float | None] | None = None
    run: Callable | None = None


def _share(parts: dict, n: int) -> float | None:
    of = parts.get("of", n)
    return parts["bad"] / of if of else None


def _times(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]


def _floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _parsed(c: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in quality.DATE_FORMATS])


def _geo_parts(df: DataFrame) -> dict[str, dict[str, Column]]:
    found = geo.detect_geo_columns(quality.numeric_columns(df))
    limit = {c: 90.0 for c in found["lat"]} | {c: 180.0 for c in found["lon"]}
    return {c: {"bad": F.count_if(F.abs(F.col(c)) > m), "of": F.count(c)} for c, m in limit.items()}


# --- checks that group --------------------------------------------------------------------------------


def _duplicates(name: str, df: DataFrame, groups: int, n: int, facts: Facts) -> list[tuple]:
    return [("all", 1 - groups / n if n else None)]


def _time_gaps(name: str, df: DataFrame, groups: int, n: int, facts: Facts) -> list[tuple]:
    """Days between the first and the last one on which nothing happened."""
    columns = [c for c in _times(df) if facts[name, "time_range", c]["low"] is not None]
    days = {c: df.select(F.to_date(c).alias("d")).where("d IS NOT NULL").distinct().count() for c in columns}
    return [(c, float(_days(facts[name, "time_range", c]) - days[c])) for c in columns]


def _geo_duplicates(name: str, df: DataFrame, groups: int, n: int, facts: Facts) -> list[tuple]:
    """Share of rows whose coordinates an earlier row has."""
    found, out = geo.detect_geo_columns(quality.numeric_columns(df)), []
    for la, lo in zip(found["lat"], found["lon"], strict=False):
        both = df.where(F.col(la).isNotNull() & F.col(lo).isNotNull()).groupBy(la, lo).agg(F.count(F.lit(1)).alias("n"))
        r = both.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pairs")).first()
        out.append((f"{la},{lo}", 1 - r["pairs"] / r["rows"] if r["rows"] else None))
    return out


def _days(facts: dict) -> int:
    return (facts["high"] - facts["low"]).days + 1


# --- checks between tables ------------------------------------------------------------------------------


def _key_overlap(tables: dict[str, DataFrame], facts: Facts) -> list[tuple]:
    """Share of a table's distinct keys that the other has, for key columns of one name; both directions."""
    keyed = {t: df.select(*[c for c in df.columns if c.lower().endswith(("key", "_id"))]) for t, df in tables.items()}
    keyed = {t: df for t, df in keyed.items() if df.columns}
    if len(keyed) < 2:
        return []
    rows = merging.pair_profiles(keyed).collect()  # a row per pair and common key
    return [x for r in rows for x in ((r["file_a"], r["file_b"], r["column"], r["overlap_vs_a"]), (r["file_b"], r["file_a"], r["column"], r["overlap_vs_b"]))]


def _time_overlap(tables: dict[str, DataFrame], facts: Facts) -> list[tuple]:
    """Days that two tables' time ranges share, by the shorter range; no scan."""
    spans = [(t, c, parts) for (t, check, c), parts in facts.items() if check == "time_range" and parts["low"] is not None]
    out = []
    for (t, c, x), (u, d, y) in combinations(spans, 2):
        if t != u:
            shared = max(0, (min(x["high"], y["high"]) - max(x["low"], y["low"])).days + 1)
            out.append((t, u, f"{c},{d}", shared / min(_days(x), _days(y))))
    return out


CHECKS = [
    Check("missing", "scalar", "missing_ratio", lambda v: v > quality.MISSING_THRESHOLD, parts=lambda df: {c: {"bad": F.count_if(quality.is_missing(df, c))} for c in df.columns}, value=_share),
    Check("infinite", "scalar", "inf_count", lambda v: v > 0, parts=lambda df: {c: {"bad": F.count_if(F.abs(F.col(c)) == float("inf"))} for c in _floats(df)}, value=lambda p, n: float(p["bad"])),
    Check("zero_inflation", "scalar", "zero_ratio", lambda v: v > quality.ZERO_THRESHOLD, parts=lambda df: {c: {"bad": F.count_if(F.col(c) == 0)} for c in quality.numeric_columns(df)}, value=_share),
    Check("skewness", "scalar", "skewness", lambda v: abs(v) > quality.SKEW_LIMIT, parts=lambda df: {c: {"x": unbiased_skewness(_finite(c))} for c in quality.numeric_columns(df)}, value=lambda p, n: p["x"]),
    Check("kurtosis", "scalar", "kurtosis", lambda v: v > quality.KURTOSIS_LIMIT, parts=lambda df: {c: {"x": unbiased_kurtosis(_finite(c))} for c in quality.numeric_columns(df)}, value=lambda p, n: p["x"]),
    Check("datetime", "scalar", "parse_ratio", lambda v: v >= quality.DATE_SUCCESS, parts=lambda df: {c: {"bad": F.count(_parsed(c)), "of": F.count(c)} for c in quality.text_columns(df)}, value=_share),
    Check("geo_range", "scalar", "outside_ratio", lambda v: v > 0, parts=_geo_parts, value=_share),
    Check("time_range", "scalar", "n_days", lambda v: False, parts=lambda df: {c: {"low": F.min(F.to_date(c)), "high": F.max(F.to_date(c))} for c in _times(df)}, value=lambda p, n: None if p["low"] is None else float(_days(p))),
    Check("duplicates", "table", "duplicate_ratio", lambda v: v > quality.DUPLICATE_THRESHOLD, run=_duplicates),
    Check("time_gaps", "table", "missing_days", lambda v: v > 0, needs=("time_range",), run=_time_gaps),
    Check("geo_duplicates", "table", "duplicate_ratio", lambda v: v > quality.DUPLICATE_THRESHOLD, run=_geo_duplicates),
    Check("key_overlap", "cross", "found_ratio", lambda v: v < 1, run=_key_overlap),
    Check("time_overlap", "cross", "shared_ratio", lambda v: v == 0, needs=("time_range",), run=_time_overlap),
]


def ordered(checks: list[Check]) -> list[Check]:
    """Checks after all that they need; needed checks that were not asked for are added."""
    known = {c.name: c for c in CHECKS} | {c.name: c for c in checks}
    graph: dict[str, tuple[str, ...]] = {}
    todo = [c.name for c in checks]
    while todo:
        name = todo.pop()
        if name not in graph:
            graph[name] = known[name].needs
            todo += known[name].needs
    return [known[n] for n in TopologicalSorter(graph).static_order()]


def scan(df: DataFrame, checks: list[Check]) -> tuple[int, int, dict[tuple[str, str], dict]]:
    """One pass over a table: its number of rows, of different rows, and the parts of all scalar checks."""
    names, aggregates = [], [F.count(F.lit(1)).alias("n")]
    for check in checks:
        if check.kind == "scalar":
            for column, parts in check.parts(df).items():
                for part, aggregate in parts.items():
                    aggregates.append(aggregate.alias(f"m{len(names)}"))
                    names.append((check.name, column, part))
    watch = Observation()
    groups = df.observe(watch, *aggregates).groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1))).first()[0]
    # The optimiser drops an empty source, and the watch on it.
    got = watch.get if groups else df.agg(*aggregates).first().asDict()
    out: dict[tuple[str, str], dict] = {}
    for i, (check, column, part) in enumerate(names):
        out.setdefault((check, column), {})[part] = got[f"m{i}"]
    return got["n"], groups, out


def audit(tables: dict[str, DataFrame], checks: list[str] | None = None) -> DataFrame:
    """Findings of all checks (or the named ones) over all tables; see ``FINDINGS``.

    A value that is not defined (an empty table or column) is null and not flagged. Column names hold no dots. Findings are as many as columns and
    pairs of tables, so they are put together on the driver.
    """
    chosen = ordered([c for c in CHECKS if checks is None or c.name in checks])
    asked = {c.name for c in CHECKS if checks is None or c.name in checks}
    sizes: dict[str, tuple[int, int]] = {}
    facts: Facts = {}
    for name, df in tables.items():
        n, groups, parts = scan(df, chosen)
        sizes[name] = (n, groups)
        facts |= {(name, check, column): p for (check, column), p in parts.items()}
    rows: list[tuple] = []

    def told(check: Check, table: str, other: str | None, column: str, value) -> None:
        if check.name in asked:
            value = None if value is None or value != value else float(value)
            rows.append((table, other, check.name, column, check.metric, value, value is not None and check.bad(value)))

    for check in chosen:
        if check.kind == "cross":
            for table, other, column, value in check.run(tables, facts):
                told(check, table, other, column, value)
            continue
        for name, df in tables.items():
            if check.kind == "scalar":
                for (table, of, column), parts in facts.items():
                    if (table, of) == (name, check.name):
                        told(check, name, None, column, check.value(parts, sizes[name][0]))
            else:
                for column, value in check.run(name, df, sizes[name][1], sizes[name][0], facts):
                    told(check, name, None, column, value)
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, FINDINGS)
