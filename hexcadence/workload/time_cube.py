"""Queries on time columns, count cubes, dense grids and window features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hexcadence.functions import timefn as T
from hexcadence.operators import cube, timebin, windows
from hexcadence.plans import forecast
from hexcadence.workload.base import (
    PLACED_ORDERS,
    placed_orders,
    query,
    sql_bin,
    table,
)

# --- clock text and timestamps ------------------------------------------------------------------

_CLOCK_TEXT = """
  SELECT event_id, CASE WHEN event_id % 7 = 0
     THEN concat(CAST(event_id % 29 AS VARCHAR), ':', CAST(event_id % 61 AS VARCHAR))
     ELSE CAST(event_id % 2460 AS VARCHAR) END AS hr_min FROM events
"""
_CLOCK_CLEAN = f"""
  SELECT event_id, hr_min,
    CASE WHEN regexp_full_match(hr_min, '[0-9]{{3}}') THEN concat('0', hr_min[1], ':', hr_min[2:3])
         WHEN length(four) = 4 AND four[1:2] <= '23' AND four[3:4] <= '59'
           THEN concat(four[1:2], ':', four[3:4]) END AS time_clean
  FROM (SELECT event_id, hr_min,
          CASE WHEN contains(hr_min, ':')
               THEN concat(lpad(split_part(hr_min, ':', 1), 2, '0'), lpad(split_part(hr_min, ':', 2), 2, '0'))
               WHEN regexp_full_match(hr_min, '[0-9]{{4}}') THEN hr_min END AS four
        FROM ({_CLOCK_TEXT}) AS raw) AS t
"""


def _clock_events(spark, d):
    i = F.col("event_id")
    text = F.when(
        i % 7 == 0, F.concat_ws(":", (i % 29).cast("string"), (i % 61).cast("string"))
    ).otherwise((i % 2460).cast("string"))
    return table(spark, d, "events").select("event_id", "ts", text.alias("hr_min"))


@query("clock_text_parse", "event_id:i hr_min:s time_clean:s", _CLOCK_CLEAN)
def clock_text_parse(spark, d):
    return timebin.with_clock(_clock_events(spark, d), "hr_min")


@query(
    "timestamp_from_parts",
    "event_id:i datetime:t",
    f"""
    WITH c AS ({_CLOCK_CLEAN}),
    p AS (SELECT event_id, 2005 + event_id % 20 AS y, 1 + event_id % 12 AS m, 1 + event_id % 31 AS d,
            CAST(time_clean[1:2] AS INTEGER) AS h, CAST(time_clean[4:5] AS INTEGER) AS mi FROM c)
    SELECT event_id, CASE WHEN h <= 23 AND mi <= 59 AND d <= day(last_day(make_date(y, m, 1)))
      THEN make_timestamp(y, m, least(d, day(last_day(make_date(y, m, 1)))), h, mi, 0e0) END AS datetime
    FROM p
    """,
)
def timestamp_from_parts(spark, d):
    i = F.col("event_id")
    raw = _clock_events(spark, d).select(
        "event_id",
        "hr_min",
        F.concat((F.lit(2005) + i % 20).cast("string"), F.lpad(i.cast("string"), 8, "0")).alias("key"),
        (F.lit(1) + i % 12).alias("month"),
        (F.lit(1) + i % 31).alias("day"),
    )
    return timebin.with_timestamp(raw, id_col="key")


@query(
    "time_parts",
    "event_id:i year:i month:i week:i day:i weekday:i hour:i minute:i second:i is_weekend:b",
    """
    SELECT event_id, year(ts) AS year, month(ts) AS month, weekofyear(ts) AS week, day(ts) AS day,
      isodow(ts) - 1 AS weekday, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second,
      isodow(ts) >= 6 AS is_weekend FROM events
    """,
)
def time_parts(spark, d):
    return timebin.with_time_parts(
        table(spark, d, "events"), "ts", [*T.TIME_PARTS, "is_weekend", "is_holiday"]
    )


_CYCLES = ", ".join(
    f"{fn}({2 * math.pi!r} * {e} / {p}e0) AS {n}_{fn}"
    for n, e, p in [
        ("month", "month(ts)", 12),
        ("week", "weekofyear(ts)", 52),
        ("day", "day(ts)", 30),
        ("weekday", "(isodow(ts) - 1)", 7),
        ("hour", "hour(ts)", 24),
    ]
    for fn in ("sin", "cos")
)


@query(
    "cyclic_encoding",
    "event_id:i month_sin:d month_cos:d week_sin:d week_cos:d day_sin:d day_cos:d "
    "weekday_sin:d weekday_cos:d hour_sin:d hour_cos:d",
    f"SELECT event_id, {_CYCLES} FROM events",
)
def cyclic_encoding(spark, d):
    parts = ["month", "week", "day", "weekday", "hour"]
    return timebin.with_cyclic(timebin.with_time_parts(table(spark, d, "events"), "ts", parts), parts)


@query(
    "bin_cyclic_features",
    "o_orderkey:i time_bin:t month_sin:d month_cos:d weekday_sin:d weekday_cos:d",
    f"""
    SELECT o_orderkey, b AS time_bin, sin({2 * math.pi!r} * month(b) / 12e0) AS month_sin,
      cos({2 * math.pi!r} * month(b) / 12e0) AS month_cos,
      sin({2 * math.pi!r} * (isodow(b) - 1) / 7e0) AS weekday_sin,
      cos({2 * math.pi!r} * (isodow(b) - 1) / 7e0) AS weekday_cos
    FROM (SELECT o_orderkey, {sql_bin('o_orderdate', 'weekly')} AS b FROM orders) AS t
    """,
)
def bin_cyclic_features(spark, d):
    o = timebin.with_bin(table(spark, d, "orders"), "o_orderdate", "weekly")
    return timebin.with_bin_cycle(o, "time_bin", "weekly")


@query(
    "time_bins",
    "o_orderkey:i day_bin:t week_bin:t month_bin:t hour_bin:t",
    f"""
    SELECT o_orderkey, {sql_bin('o_orderdate', 'daily')} AS day_bin, {sql_bin('o_orderdate', 'weekly')} AS week_bin,
      {sql_bin('o_orderdate', 'monthly')} AS month_bin, {sql_bin('o_orderdate', 'hourly')} AS hour_bin FROM orders
    """,
)
def time_bins(spark, d):
    o = table(spark, d, "orders")
    for freq, out in [("daily", "day_bin"), ("weekly", "week_bin"), ("monthly", "month_bin"), ("hourly", "hour_bin")]:
        o = timebin.with_bin(o, "o_orderdate", freq, out)
    return o


def _sql_n_week(n):
    a = "DATE '2000-01-03'"
    days = f"date_diff('day', {a}, CAST(date_trunc('week', o_orderdate) AS DATE))"
    return f"CAST({a} + CAST(floor({days} / {7 * n}e0) * {7 * n} AS INTEGER) AS TIMESTAMP)"


@query(
    "n_weekly_bins",
    "o_orderkey:i two_weekly:t three_weekly:t four_weekly:t five_weekly:t",
    "SELECT o_orderkey, "
    + ", ".join(f"{_sql_n_week(n)} AS {w}_weekly" for n, w in T.N_WEEK_NAMES.items())
    + " FROM orders",
)
def n_weekly_bins(spark, d):
    o = table(spark, d, "orders")
    for n in T.N_WEEK_NAMES:
        o = timebin.with_n_weekly(o, "o_orderdate", n)
    return o


@query(
    "time_limits",
    "lower:t upper:t",
    """
    SELECT make_timestamp(min(year(o_orderdate)), 1, 1, 0, 0, 0e0) AS lower,
           make_timestamp(max(year(o_orderdate)), 12, 31, 23, 59, 59e0) AS upper FROM orders
    """,
)
def time_limits(spark, d):
    return timebin.time_limits(table(spark, d, "orders"), "o_orderdate")


def _calendar_sql(first: str, step: str) -> str:
    return f"""
    WITH l AS (SELECT make_timestamp(min(year(o_orderdate)), 1, 1, 0, 0, 0e0) AS lo,
                      make_timestamp(max(year(o_orderdate)), 12, 31, 23, 59, 59e0) AS hi FROM orders)
    SELECT unnest(generate_series({first}, hi, INTERVAL {step})) AS time_bin FROM l
    """


_FIRST_MONDAY = "lo + INTERVAL 1 DAY * ((7 - (isodow(lo) - 1)) % 7)"
for _freq, _first, _step in [
    ("weekly", _FIRST_MONDAY, "7 DAY"),
    ("two_weekly", _FIRST_MONDAY, "14 DAY"),
    ("monthly", "lo", "1 MONTH"),
    ("daily", "lo", "1 DAY"),
]:

    @query(f"calendar_{_freq}", "time_bin:t", _calendar_sql(_first, _step))
    def calendar_bins(spark, d, _freq=_freq):
        limits = timebin.time_limits(table(spark, d, "orders"), "o_orderdate")
        return timebin.calendar(limits, _freq)


@query(
    "rush_hour_flag",
    "event_id:i is_rush_hour:i",
    """
    SELECT event_id, CASE WHEN hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 18 THEN 1 ELSE 0 END
      AS is_rush_hour FROM events
    """,
)
def rush_hour_flag(spark, d):
    return timebin.with_rush_hour(table(spark, d, "events").withColumn("hour", F.hour("ts")), "hour")


@query(
    "time_gaps_hourly",
    "missing_bin:t",
    """
    WITH s AS (SELECT DISTINCT date_trunc('hour', o_orderdate) AS b FROM orders),
    x AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS missing_bin FROM s)
    SELECT missing_bin FROM x WHERE missing_bin NOT IN (SELECT b FROM s)
    """,
)
def time_gaps_hourly(spark, d):
    return timebin.time_gaps(table(spark, d, "orders"), "o_orderdate", "hourly")


@query(
    "time_gaps_daily",
    "missing_bin:t",
    """
    WITH s AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS b FROM orders),
    x AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 DAY)) AS missing_bin FROM s)
    SELECT missing_bin FROM x WHERE missing_bin NOT IN (SELECT b FROM s)
    """,
)
def time_gaps_daily(spark, d):
    return timebin.time_gaps(table(spark, d, "orders"), "o_orderdate", "daily")


# --- cubes --------------------------------------------------------------------------------------

_WEEK = sql_bin("ts", "weekly")
_DAY = sql_bin("ts", "daily")
_DAILY_COUNTS = f"SELECT user_id, {_DAY} AS time_bin, count(*) AS n FROM events GROUP BY 1, 2"
_WEEKLY_COUNTS = f"SELECT user_id, {_WEEK} AS time_bin, count(*) AS n FROM events GROUP BY 1, 2"
_ORDER_COUNTS = f"""
  SELECT o_custkey, {sql_bin('o_orderdate', 'monthly')} AS time_bin, count(*) AS n FROM orders GROUP BY 1, 2
"""


def daily_counts(spark, d):
    return cube.count_cube(timebin.with_bin(table(spark, d, "events"), "ts", "daily"), "user_id", "time_bin")


def monthly_orders(spark, d):
    o = timebin.with_bin(table(spark, d, "orders"), "o_orderdate", "monthly")
    return cube.count_cube(o, "o_custkey", "time_bin")


@query("count_cube_daily", "user_id:i time_bin:t n:i", _DAILY_COUNTS)
def count_cube_daily(spark, d):
    return daily_counts(spark, d)


@query(
    "count_cube_region_month",
    "n_regionkey:i time_bin:t n:i",
    f"SELECT n_regionkey, {sql_bin('o_orderdate', 'monthly')} AS time_bin, count(*) AS n FROM ({PLACED_ORDERS}) AS p GROUP BY 1, 2",
)
def count_cube_region_month(spark, d):
    return cube.count_cube(
        timebin.with_bin(placed_orders(spark, d), "o_orderdate", "monthly"), "n_regionkey", "time_bin"
    )


@query(
    "active_cells",
    "o_custkey:i",
    f"SELECT o_custkey FROM ({_ORDER_COUNTS}) AS c GROUP BY 1 HAVING sum(n) >= 10",
)
def active_cells(spark, d):
    return cube.active_cells(monthly_orders(spark, d), "o_custkey", "n", min_events=10)


def _dense_sql(counts: str, cell: str, min_events: int, full_step: str | None = None) -> str:
    bins = (
        f"SELECT unnest(generate_series(min(time_bin), max(time_bin), INTERVAL {full_step})) AS time_bin FROM c"
        if full_step
        else "SELECT DISTINCT time_bin FROM c"
    )
    return f"""
    WITH c AS ({counts}),
    a AS (SELECT {cell} FROM c GROUP BY 1 HAVING sum(n) >= {min_events}),
    b AS ({bins})
    SELECT a.{cell}, b.time_bin, coalesce(c.n, 0) AS n
    FROM a CROSS JOIN b LEFT JOIN c ON c.{cell} = a.{cell} AND c.time_bin = b.time_bin
    """


@query("dense_cube_observed", "user_id:i time_bin:t n:i", _dense_sql(_DAILY_COUNTS, "user_id", 2))
def dense_cube_observed(spark, d):
    return cube.densify(daily_counts(spark, d), "user_id", "time_bin", "n", "daily", min_events=2)


@query(
    "dense_cube_full_calendar",
    "o_custkey:i time_bin:t n:i",
    _dense_sql(_ORDER_COUNTS, "o_custkey", 1, "1 MONTH"),
)
def dense_cube_full_calendar(spark, d):
    return cube.densify(
        monthly_orders(spark, d), "o_custkey", "time_bin", "n", "monthly", calendar="full"
    )


@query(
    "dense_cube_hourly",
    "event_type:s time_bin:t n:i",
    f"""
    WITH c AS (SELECT event_type, {sql_bin('ts', 'hourly')} AS time_bin, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT a.event_type, b.time_bin, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT event_type FROM c) a
    CROSS JOIN (SELECT DISTINCT time_bin FROM c) b
    LEFT JOIN c ON c.event_type = a.event_type AND c.time_bin = b.time_bin
    """,
)
def dense_cube_hourly(spark, d):
    e = timebin.with_bin(table(spark, d, "events"), "ts", "hourly")
    return cube.densify(cube.count_cube(e, "event_type", "time_bin"), "event_type", "time_bin", "n", "hourly")


@query(
    "complete_grid",
    "o_custkey:i o_orderpriority:s n:i",
    """
    WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT k.c_custkey AS o_custkey, p.p AS o_orderpriority, coalesce(c.n, 0) AS n
    FROM customer k CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS p) p
    LEFT JOIN c ON c.o_custkey = k.c_custkey AND c.o_orderpriority = p.p
    """,
)
def complete_grid(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return cube.complete_grid(
        counts, "o_custkey", keys, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "n"
    )


def _yearly_cubes(spark, d, key="o_custkey"):
    """The cubes of all years in one frame, from one scan; weeks across new year occur in two of them."""
    o = table(spark, d, "orders").withColumns(
        {"bin": T.bin_start("o_orderdate", "weekly"), "year": F.year("o_orderdate")}
    )
    return [o.groupBy(key, "bin", "year").agg(F.count(F.lit(1)).alias("n")).drop("year")]


@query(
    "merge_yearly_cubes_sum",
    "o_custkey:i bin:t n:i",
    f"SELECT o_custkey, {sql_bin('o_orderdate', 'weekly')} AS bin, count(*) AS n FROM orders GROUP BY 1, 2",
)
def merge_yearly_cubes_sum(spark, d):
    return cube.reaggregate(_yearly_cubes(spark, d), ["o_custkey", "bin"], "n")


@query(
    "merge_yearly_cubes_max",
    "o_orderpriority:s bin:t n:i",
    f"""
    SELECT o_orderpriority, bin, max(n) AS n FROM (
      SELECT o_orderpriority, year(o_orderdate) AS y, {sql_bin('o_orderdate', 'weekly')} AS bin, count(*) AS n
      FROM orders GROUP BY 1, 2, 3) AS t GROUP BY 1, 2
    """,
)
def merge_yearly_cubes_max(spark, d):
    return cube.reaggregate(
        _yearly_cubes(spark, d, "o_orderpriority"), ["o_orderpriority", "bin"], "n", how="max"
    )


@query(
    "binary_target",
    "user_id:i time_bin:t n:i has_event:i",
    f"SELECT *, CAST(n > 0 AS INTEGER) AS has_event FROM ({_dense_sql(_DAILY_COUNTS, 'user_id', 2)}) AS g",
)
def binary_target(spark, d):
    return cube.with_target(dense_cube_observed(spark, d), "n")


@query(
    "first_days",
    "day:i n:i",
    "SELECT day(ts) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 10",
)
def first_days(spark, d):
    return cube.daily_counts(table(spark, d, "events").withColumn("day", F.dayofmonth("ts")), "day")


@query(
    "region_month_counts",
    "n_regionkey:i month:i n:i",
    f"""
    SELECT n_regionkey, month(o_orderdate) AS month, count(*) AS n FROM ({PLACED_ORDERS}) AS p
    WHERE o_totalprice > 1000 GROUP BY 1, 2
    """,
)
def region_month_counts(spark, d):
    o = placed_orders(spark, d).withColumn("month", F.month("o_orderdate"))
    return cube.region_month_counts(o, "n_regionkey", "month", F.col("o_totalprice") > 1000)


@query(
    "value_ranges",
    "n_rows:i min_year:i max_year:i min_month:i max_month:i min_hour:i max_hour:i",
    """
    SELECT count(*) AS n_rows, min(year(ts)) AS min_year, max(year(ts)) AS max_year, min(month(ts)) AS min_month,
      max(month(ts)) AS max_month, min(hour(ts)) AS min_hour, max(hour(ts)) AS max_hour FROM events
    """,
)
def value_ranges(spark, d):
    e = timebin.with_time_parts(table(spark, d, "events"), "ts", ["year", "month", "hour"])
    return cube.value_ranges(e, ["year", "month", "hour"])


@query(
    "category_mix",
    "user_id:i time_bin:t ratio_click:d ratio_view:d ratio_other:d entropy:d n_values:i max_ratio:d",
    f"""
    WITH c AS (SELECT user_id, {_WEEK} AS time_bin, event_type, count(*) AS k FROM events GROUP BY 1, 2, 3),
    s AS (SELECT *, k / CAST(sum(k) OVER (PARTITION BY user_id, time_bin) AS DOUBLE) AS p FROM c)
    SELECT user_id, time_bin, coalesce(sum(p) FILTER (event_type = 'click'), 0) AS ratio_click,
      coalesce(sum(p) FILTER (event_type = 'view'), 0) AS ratio_view,
      coalesce(sum(p) FILTER (event_type NOT IN ('click', 'view')), 0) AS ratio_other,
      -sum(p * ln(p)) AS entropy, count(*) AS n_values, max(p) AS max_ratio
    FROM s GROUP BY 1, 2
    """,
)
def category_mix(spark, d):
    e = timebin.with_bin(table(spark, d, "events"), "ts", "weekly")
    return cube.category_mix(e, "user_id", "time_bin", "event_type", ["click", "view"])


_URGENT = "SELECT *, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent FROM orders"


def _urgent_orders(spark, d):
    return table(spark, d, "orders").withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("int"))


@query(
    "target_mean_encoding",
    "o_orderkey:i urgent:i o_custkey_te:d",
    f"SELECT o_orderkey, urgent, avg(urgent) OVER (PARTITION BY o_custkey) AS o_custkey_te FROM ({_URGENT}) AS o",
)
def target_mean_encoding(spark, d):
    return cube.target_mean_encode(_urgent_orders(spark, d), "o_custkey", "urgent")


@query(
    "smoothed_target_encoding",
    "o_custkey:i o_custkey_te:d global_mean:d",
    f"""
    WITH u AS ({_URGENT}), g AS (SELECT avg(urgent) AS m FROM u)
    SELECT o_custkey, (sum(urgent) + 10e0 * max(m)) / (count(*) + 10e0) AS o_custkey_te, max(m) AS global_mean
    FROM u CROSS JOIN g GROUP BY 1
    """,
)
def smoothed_target_encoding(spark, d):
    return cube.smoothed_encoding(_urgent_orders(spark, d), "o_custkey", "urgent")


@query(
    "apply_target_encoding",
    "o_orderkey:i o_custkey_te:d",
    f"""
    WITH u AS ({_URGENT}), tr AS (SELECT * FROM u WHERE o_orderdate < TIMESTAMP '1999-06-01'),
    g AS (SELECT avg(urgent) AS m FROM tr),
    e AS (SELECT o_custkey, (sum(urgent) + 10e0 * max(m)) / (count(*) + 10e0) AS te FROM tr CROSS JOIN g GROUP BY 1)
    SELECT o_orderkey, coalesce(te, m) AS o_custkey_te
    FROM u CROSS JOIN g LEFT JOIN e ON u.o_custkey = e.o_custkey WHERE o_orderdate >= TIMESTAMP '1999-06-01'
    """,
)
def apply_target_encoding(spark, d):
    u = _urgent_orders(spark, d)
    cut = F.lit("1999-06-01").cast("timestamp_ntz")
    fitted = cube.smoothed_encoding(u.where(F.col("o_orderdate") < cut), "o_custkey", "urgent")
    return cube.apply_encoding(u.where(F.col("o_orderdate") >= cut), fitted, "o_custkey", "global_mean")


# --- windows ------------------------------------------------------------------------------------


def features_sql(grid: str, cell: str) -> str:
    """Feature columns of a dense cube (cell, time_bin, n)."""
    w = f"PARTITION BY {cell} ORDER BY time_bin"
    lags = ", ".join(f"coalesce(lag(n, {k}) OVER ({w}), 0) AS lag_{k}" for k in windows.LAGS)
    rolls = ", ".join(
        f"coalesce(CASE WHEN count(n) OVER ({w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} "
        f"THEN {fn}(n) OVER ({w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END, 0) AS roll_{s}_{k}"
        for k in windows.ROLLS
        for s, fn in [("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp")]
    )
    return f"""
    WITH g AS ({grid}),
    r AS (SELECT *, row_number() OVER ({w}) AS rn, {lags}, {rolls} FROM g),
    z AS (SELECT *, rn - max(CASE WHEN n <> 0 OR rn = 1 THEN rn END) OVER ({w}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zero_streak FROM r)
    SELECT *, coalesce(lag(zero_streak) OVER ({w}), 0) AS zero_streak_prev,
      CAST(lag_1 > 0 AS INTEGER) AS had_event_last FROM z
    """


FEATURE_COLS = (
    " ".join(f"lag_{k}:i" for k in windows.LAGS)
    + " "
    + " ".join(f"roll_mean_{k}:d roll_sum_{k}:i roll_std_{k}:d" for k in windows.ROLLS)
    + " zero_streak:i zero_streak_prev:i had_event_last:i"
)


@query(
    "ts_features_weekly_users",
    f"user_id:i time_bin:t n:i {FEATURE_COLS}",
    features_sql(_dense_sql(_WEEKLY_COUNTS, "user_id", 2), "user_id"),
)
def ts_features_weekly_users(spark, d):
    return forecast.feature_table(table(spark, d, "events"), "user_id", "ts", "weekly", target="n")


@query(
    "ts_features_monthly_customers",
    f"o_custkey:i time_bin:t n:i {FEATURE_COLS}",
    features_sql(_dense_sql(_ORDER_COUNTS, "o_custkey", 2), "o_custkey"),
)
def ts_features_monthly_customers(spark, d):
    return forecast.feature_table(
        table(spark, d, "orders"), "o_custkey", "o_orderdate", "monthly", target="n"
    )


@query(
    "mean_abs_change",
    "mean_abs_change:d",
    f"""
    SELECT avg(abs(n - p)) AS mean_abs_change FROM (
      SELECT n, lag(n) OVER (PARTITION BY user_id ORDER BY time_bin) AS p
      FROM ({_dense_sql(_DAILY_COUNTS, 'user_id', 2)}) AS g) AS t
    """,
)
def mean_abs_change(spark, d):
    return windows.mean_abs_change(dense_cube_observed(spark, d), "user_id", "time_bin", "n")


@query(
    "next_bin_target",
    "user_id:i time_bin:t n:i y_next:i",
    f"""
    SELECT * FROM (SELECT *, lead(n) OVER (PARTITION BY user_id ORDER BY time_bin) AS y_next
      FROM ({_dense_sql(_DAILY_COUNTS, 'user_id', 2)}) AS g) AS t WHERE y_next IS NOT NULL
    """,
)
def next_bin_target(spark, d):
    return windows.next_bin_target(dense_cube_observed(spark, d), "user_id", "time_bin", "n")


@query(
    "average_rank",
    "event_type:s n:i rank:d",
    """
    WITH c AS (SELECT event_type, count(*) // 100 AS n FROM events GROUP BY 1)
    SELECT event_type, n, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2e0 AS rank FROM c
    """,
)
def average_rank(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.floor(F.count("*") / 100).alias("n"))
    return windows.average_rank(c, "n")


@query(
    "warmup_and_one_hot",
    "o_custkey:i time_bin:t n:i " + " ".join(f"month_{m}:i" for m in range(1, 13)),
    f"""
    SELECT *, {', '.join(f'CAST(month(time_bin) = {m} AS INTEGER) AS month_{m}' for m in range(1, 13))}
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY time_bin) AS rn
          FROM ({_dense_sql(_ORDER_COUNTS, 'o_custkey', 2)}) AS g) AS t WHERE rn > 8
    """,
)
def warmup_and_one_hot(spark, d):
    grid = cube.densify(monthly_orders(spark, d), "o_custkey", "time_bin", "n", "monthly", min_events=2)
    kept = windows.drop_warmup(grid, "o_custkey", "time_bin", 8).withColumn("month", F.month("time_bin"))
    return windows.one_hot(kept, "month", range(1, 13))
