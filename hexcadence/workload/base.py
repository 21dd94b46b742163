"""Registry of queries: a Spark function, the result columns, and the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Result types: integer, double (6 or 2 digits), text, timestamp, flag.
_SPARK = {
    "i": lambda c: c.cast("bigint"),
    "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0),
    "d2": lambda c: F.round(c.cast("double"), 2) + F.lit(0.0),
    "s": lambda c: c.cast("string"),
    "t": lambda c: c.cast("timestamp_ntz"),
    "b": lambda c: c.cast("boolean"),
}
_SQL = {
    "i": "CAST({c} AS BIGINT)",
    "d": "round(CAST({c} AS DOUBLE), 6) + 0e0",
    "d2": "round(CAST({c} AS DOUBLE), 2) + 0e0",
    "s": "CAST({c} AS VARCHAR)",
    "t": "CAST({c} AS TIMESTAMP)",
    "b": "CAST({c} AS BOOLEAN)",
}


def query(name: str, cols: str, sql: str | None = None):
    """Register a query; ``cols`` is ``name:type name:type ...`` and fixes the result on both sides."""
    spec = [c.rsplit(":", 1) for c in cols.split()]

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[_SPARK[t](F.col(c)).alias(c) for c, t in spec])

        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(_SQL[t].format(c=f'"{c}"') + f' AS "{c}"' for c, t in spec)
            ORACLES[name] = f"SELECT {picked} FROM ({sql}) AS result"
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events with a place ------------------------------------------------------------------------


def event_lat() -> Column:
    return F.lit(42.0) + F.pmod(F.col("event_id") * 7919, F.lit(9000)) / F.lit(1000.0)


def event_lon() -> Column:
    return F.lit(-4.0) + F.pmod(F.col("event_id") * 104729, F.lit(12000)) / F.lit(1000.0)


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"lat": event_lat(), "lon": event_lon()})


PLACED_EVENTS = """
  SELECT *, 42e0 + (event_id * 7919 % 9000) / 1e3 AS lat,
         -4e0 + (event_id * 104729 % 12000) / 1e3 AS lon
  FROM events
"""


def broken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates damaged by kind: as is, x 1e5, swapped, null, zero, swapped and x 1e5."""
    e = placed_events(spark, sf_dir).withColumn("kind", F.pmod("event_id", F.lit(6)))
    k, la, lo = F.col("kind"), F.col("lat"), F.col("lon")
    big = F.lit(1e5)
    bad_lat = (
        F.when(k == 0, la).when(k == 1, la * big).when(k == 2, lo).when(k == 4, 0.0).when(k == 5, lo * big)
    )
    bad_lon = (
        F.when(k == 0, lo).when(k == 1, lo * big).when(k == 2, la).when(k == 4, 0.0).when(k == 5, la * big)
    )
    return e.withColumns({"latitude": bad_lat, "longitude": bad_lon})


BROKEN_EVENTS = f"""
  SELECT *, CASE event_id % 6 WHEN 0 THEN lat WHEN 1 THEN lat * 1e5 WHEN 2 THEN lon
            WHEN 4 THEN 0e0 WHEN 5 THEN lon * 1e5 END AS latitude,
         CASE event_id % 6 WHEN 0 THEN lon WHEN 1 THEN lon * 1e5 WHEN 2 THEN lat
            WHEN 4 THEN 0e0 WHEN 5 THEN lat * 1e5 END AS longitude
  FROM ({PLACED_EVENTS}) AS placed
"""


# --- orders with a place ------------------------------------------------------------------------


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the chain customer -> nation -> region as three resolutions."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, sf_dir, "orders").join(c, "o_custkey").join(n, "c_nationkey")


PLACED_ORDERS = """
  SELECT o.*, c.c_nationkey, n.n_regionkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


def sql_bin(ts: str, freq: str) -> str:
    """SQL of a bin start."""
    if freq == "two_weekly":
        anchor = "DATE '2000-01-03'"
        days = f"date_diff('day', {anchor}, CAST(date_trunc('week', {ts}) AS DATE))"
        return f"CAST({anchor} + CAST(floor({days} / 14e0) * 14 AS INTEGER) AS TIMESTAMP)"
    unit = {"monthly": "month", "weekly": "week", "daily": "day", "hourly": "hour"}[freq]
    return f"CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP)"
