"""Queries on series kept as runs; the SQL grows the dense grid and works on that."""

from __future__ import annotations

from hexcadence.operators import cube, timebin, zeroruns
from hexcadence.workload.base import query, sql_bin, table
from hexcadence.workload.time_cube import _ORDER_COUNTS, _WEEKLY_COUNTS, FEATURE_COLS, _dense_sql, features_sql

_FEATURES = [c.split(":")[0] for c in FEATURE_COLS.split()]
_HOURLY = f"SELECT user_id, {sql_bin('ts', 'hourly')} AS time_bin, count(*) AS n FROM events GROUP BY 1, 2"


def _series(spark, d, name, key, ts, freq, calendar):
    counts = cube.count_cube(timebin.with_bin(table(spark, d, name), ts, freq), key, "time_bin")
    return counts, zeroruns.calendar_index(counts, "time_bin", freq, calendar)


def _runs_sql(grid: str, key: str) -> str:
    """Islands of zeros of a dense cube; an event is a run of its own."""
    return f"""
    WITH g AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY time_bin) AS rn FROM ({grid}) AS dense),
    i AS (SELECT *, CASE WHEN n = 0 THEN rn - row_number() OVER (PARTITION BY {key}, n = 0 ORDER BY time_bin) ELSE -rn END AS island
          FROM g)
    SELECT {key}, min(time_bin) AS time_bin, count(*) AS n_bins, max(n) AS n FROM i GROUP BY {key}, island
    """


@query("zero_runs_hourly_users", "user_id:i time_bin:t n_bins:i n:i", _runs_sql(_dense_sql(_HOURLY, "user_id", 2), "user_id"))
def zero_runs_hourly_users(spark, d):
    counts, bins = _series(spark, d, "events", "user_id", "ts", "hourly", "observed")
    return zeroruns.zero_runs(counts, "user_id", "time_bin", "n", bins, min_events=2).join(bins, "at")


@query(
    "zero_runs_monthly_customers",
    "o_custkey:i time_bin:t n_bins:i n:i",
    _runs_sql(_dense_sql(_ORDER_COUNTS, "o_custkey", 1, "1 MONTH"), "o_custkey"),
)
def zero_runs_monthly_customers(spark, d):
    counts, bins = _series(spark, d, "orders", "o_custkey", "o_orderdate", "monthly", "full")
    return zeroruns.zero_runs(counts, "o_custkey", "time_bin", "n", bins).join(bins, "at")


@query(
    "feature_runs_weekly_users",
    f"user_id:i time_bin:t n:i {FEATURE_COLS}",
    features_sql(_dense_sql(_WEEKLY_COUNTS, "user_id", 2), "user_id"),
)
def feature_runs_weekly_users(spark, d):
    counts, bins = _series(spark, d, "events", "user_id", "ts", "weekly", "observed")
    return zeroruns.expand(zeroruns.feature_runs(counts, "user_id", "time_bin", "n", bins, min_events=2), bins, "time_bin")


@query(
    "feature_runs_monthly_customers",
    f"o_custkey:i time_bin:t n:i {FEATURE_COLS}",
    features_sql(_dense_sql(_ORDER_COUNTS, "o_custkey", 2, "1 MONTH"), "o_custkey"),
)
def feature_runs_monthly_customers(spark, d):
    counts, bins = _series(spark, d, "orders", "o_custkey", "o_orderdate", "monthly", "full")
    return zeroruns.expand(zeroruns.feature_runs(counts, "o_custkey", "time_bin", "n", bins, min_events=2), bins, "time_bin")


def _moments_sql(grid: str, key: str) -> str:
    parts = [f"SELECT '{c}' AS feature, count(*) AS n_rows, avg({c}) AS mean, stddev_samp({c}) AS std FROM f" for c in _FEATURES]
    return f"WITH f AS ({features_sql(grid, key)}) {' UNION ALL '.join(parts)}"


@query(
    "feature_moments_of_runs",
    "feature:s n_rows:i mean:d std:d",
    _moments_sql(_dense_sql(_HOURLY, "user_id", 2), "user_id"),
)
def feature_moments_of_runs(spark, d):
    counts, bins = _series(spark, d, "events", "user_id", "ts", "hourly", "observed")
    runs = zeroruns.feature_runs(counts, "user_id", "time_bin", "n", bins, min_events=2)
    return zeroruns.moments(runs, "n", _FEATURES)
