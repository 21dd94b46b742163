"""Whole runs: raw events to features to cubes, and yearly tables to one clean table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcadence.functions import timefn as T
from hexcadence.operators import cube
from hexcadence.plans import features, forecast, ingest
from hexcadence.sources import tables
from hexcadence.workload.base import BROKEN_EVENTS, broken_events, query, sql_bin, table
from hexcadence.workload.cleaning import _RENAME, _yearly_variants
from hexcadence.workload.geo_cells import _repair, cells_sql
from hexcadence.workload.time_cube import FEATURE_COLS, features_sql

_RES = list(features.RESOLUTIONS)
_REPAIRED = f"SELECT *, {_repair('latitude')} AS la, {_repair('longitude')} AS lo FROM ({BROKEN_EVENTS}) AS b"
_PLACED = cells_sql(_RES, _REPAIRED, "la", "lo")
# The given events lie on a lattice that has no two of them in a cell of level 4: series are counted on level 2.
_COARSE = [2, *_RES]
_PLACED_COARSE = cells_sql(_COARSE, _REPAIRED, "la", "lo")


def places(spark, d, resolutions=features.RESOLUTIONS):
    return features.place_features(broken_events(spark, d), "event_id", "latitude", "longitude", resolutions=resolutions)


@query(
    "place_features",
    "event_id:i latitude_convert:d longitude_convert:d " + " ".join(f"cell_res{r}:s" for r in _RES),
    f"SELECT *, la AS latitude_convert, lo AS longitude_convert FROM ({_PLACED}) AS p",
)
def place_features(spark, d):
    return places(spark, d)


@query(
    "event_features",
    "event_id:i cell_res4:s datetime:t month:i weekday:i is_weekend:b month_sin:d hour_cos:d",
    f"""
    SELECT event_id, cell_res4, ts AS datetime, month(ts) AS month, isodow(ts) - 1 AS weekday, isodow(ts) >= 6 AS is_weekend,
      sin(2 * pi() * month(ts) / 12e0) AS month_sin, cos(2 * pi() * hour(ts) / 24e0) AS hour_cos FROM ({_PLACED}) AS p
    """,
)
def event_features(spark, d):
    times = features.time_features(table(spark, d, "events"), "event_id", timestamp="ts")
    columns = ["event_id", "cell_res4", "datetime", "month", "weekday", "is_weekend", "month_sin", "hour_cos"]
    return features.event_features(times, places(spark, d), "event_id", columns)


_CELL_DAYS = f"SELECT cell_res2, {sql_bin('ts', 'daily')} AS time_bin, count(*) AS n FROM ({_PLACED_COARSE}) AS p GROUP BY 1, 2"


@query(
    "cell_forecast_features",
    f"cell_res2:s time_bin:t n:i has_event:i {FEATURE_COLS}",
    features_sql(
        f"""
        SELECT a.cell_res2, b.time_bin, CAST(coalesce(c.n, 0) > 0 AS INTEGER) AS n, coalesce(c.n, 0) AS events
        FROM (SELECT cell_res2 FROM ({_CELL_DAYS}) AS x GROUP BY 1 HAVING sum(n) >= 2) a
        CROSS JOIN (SELECT DISTINCT time_bin FROM ({_CELL_DAYS}) AS y) b
        LEFT JOIN ({_CELL_DAYS}) c ON c.cell_res2 = a.cell_res2 AND c.time_bin = b.time_bin
        """,
        "cell_res2",
    )
    .replace("SELECT *, coalesce(lag(zero_streak)", "SELECT * EXCLUDE (n, events), events AS n, n AS has_event, coalesce(lag(zero_streak)"),
)
def cell_forecast_features(spark, d):
    times = table(spark, d, "events").select("event_id", F.col("ts").alias("datetime"))
    joined = features.event_features(times, places(spark, d, _COARSE), "event_id", ["cell_res2", "datetime"])
    return forecast.feature_table(joined, "cell_res2", "datetime", "daily")


@query(
    "cube_table_scan",
    "resolution:i freq:s cell:i time_bin:t n:i",
    " UNION ALL ".join(
        f"SELECT {r} AS resolution, '{f}' AS freq, {c} AS cell, {sql_bin('o_orderdate', f)} AS time_bin, count(*) AS n FROM orders GROUP BY ALL"
        for r, c in [(4, "o_custkey"), (3, "o_custkey // 10")]
        for f in ["weekly", "monthly"]
    ),
)
def cube_table_scan(spark, d):
    o = table(spark, d, "orders")
    names = {}
    for r, c in [(4, F.col("o_custkey")), (3, F.floor(F.col("o_custkey") / 10))]:
        for f in ["weekly", "monthly"]:
            binned = o.select(c.alias("cell"), T.bin_start("o_orderdate", f).alias("time_bin"))
            names[r, f] = f"cube_res{r}_{f}"
            cube.count_cube(binned, "cell", "time_bin").createOrReplaceTempView(names[r, f])
    return tables.scan_cubes(spark, names)


@query(
    "yearly_ingest",
    "order_id:i customer:i priority:s price:d source_year:i",
    """
    WITH u AS (SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderpriority AS priority,
      CASE WHEN year(o_orderdate) >= 1997 THEN o_totalprice END AS price, year(o_orderdate) AS source_year FROM orders)
    SELECT order_id, customer, priority, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM u)) AS price, source_year FROM u
    """,
)
def yearly_ingest(spark, d):
    return ingest.harmonised_and_clean(
        _yearly_variants(spark, d),
        rename=_RENAME,
        drop=["comment"],
        numeric=["price"],
        categorical=["priority"],
        integers=["order_id", "customer"],
        plan=[{"action": "impute_nan", "target": ["price"], "params": {"strategy": "median"}}],
    )
