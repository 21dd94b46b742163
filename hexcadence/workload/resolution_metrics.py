"""Queries on distribution and stability metrics of count cubes, and on feature descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcadence.operators import cube, geo, resolution, timebin
from hexcadence.workload.base import (
    PLACED_ORDERS,
    placed_events,
    placed_orders,
    query,
    sql_bin,
    table,
)
from hexcadence.workload.geo_cells import cells_sql
from hexcadence.workload.time_cube import dense_cube_observed, monthly_orders, _DAILY_COUNTS, _ORDER_COUNTS, _dense_sql

_GRID = _dense_sql(_DAILY_COUNTS, "user_id", 2)
_MONTH_GRID = _dense_sql(_ORDER_COUNTS, "o_custkey", 2)


def _month_grid(spark, d):
    return cube.densify(monthly_orders(spark, d), "o_custkey", "time_bin", "n", "monthly", min_events=2)


_STATS_COLS = (
    "rows:i sum:i min:i mean:d var:d std:d dispersion:d q25:d median:d q75:d q90:d q95:d q99:d max:i "
    "non_zero_count:i non_zero_share:d zero_count:i zero_share:d"
)


def _stats_sql(prefix: str = "") -> str:
    qs = ", ".join(f"quantile_cont(n, {p}) AS {k}" for k, p in resolution.QUANTILES.items())
    return f"""
      count(*) AS rows, sum(n) AS sum, min(n) AS min, CASE WHEN avg(n) > 1e-6 THEN avg(n) END AS mean,
      var_samp(n) AS var, stddev_samp(n) AS std, CASE WHEN avg(n) > 1e-6 THEN var_samp(n) / avg(n) END AS dispersion,
      {qs}, max(n) AS max, count(*) FILTER (n <> 0) AS non_zero_count,
      count(*) FILTER (n <> 0) / CAST(count(*) AS DOUBLE) AS non_zero_share,
      count(*) FILTER (n = 0) AS zero_count, count(*) FILTER (n = 0) / CAST(count(*) AS DOUBLE) AS zero_share
    """


@query("cube_base_stats", _STATS_COLS, f"SELECT {_stats_sql()} FROM ({_GRID}) AS g")
def cube_base_stats(spark, d):
    return resolution.base_stats(dense_cube_observed(spark, d), "n")


@query("cube_base_stats_monthly", _STATS_COLS, f"SELECT {_stats_sql()} FROM ({_MONTH_GRID}) AS g")
def cube_base_stats_monthly(spark, d):
    return resolution.base_stats(_month_grid(spark, d), "n")


@query(
    "entropy_of_mass",
    "entropy:d",
    f"""
    SELECT -sum(p * ln(p)) AS entropy FROM (
      SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM ({_GRID}) AS g) AS t WHERE p > 0
    """,
)
def entropy_of_mass(spark, d):
    return resolution.entropy(dense_cube_observed(spark, d), "n")


@query(
    "entropy_of_histogram",
    "entropy:d",
    f"""
    SELECT -sum(p * ln(p)) AS entropy FROM (
      SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM ({_GRID}) AS g GROUP BY n) AS t
    """,
)
def entropy_of_histogram(spark, d):
    return resolution.entropy(dense_cube_observed(spark, d), "n", kind="histogram")


def _gini_sql(source: str, value: str) -> str:
    return f"""
    SELECT 2 * sum(i * CAST(x AS DOUBLE)) / (count(*) * sum(CAST(x AS DOUBLE))) - (count(*) + 1) / CAST(count(*) AS DOUBLE)
      AS gini FROM (SELECT {value} AS x, row_number() OVER (ORDER BY {value}) AS i FROM ({source}) AS g) AS t
    """


@query("gini_counts", "gini:d", _gini_sql(_GRID, "n"))
def gini_counts(spark, d):
    return resolution.gini(dense_cube_observed(spark, d), "n", zero_sum=0.0)


@query("gini_order_value", "gini:d", _gini_sql("SELECT * FROM orders", "o_totalprice"))
def gini_order_value(spark, d):
    return resolution.gini(table(spark, d, "orders"), "o_totalprice")


def _corr_sql(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / NULLIF(stddev_samp({x}) * stddev_samp({y}), 0)"


def _stability_sql(grid: str, cell: str) -> str:
    return f"""
    WITH g AS ({grid}),
    p AS (SELECT {cell}, CAST(n AS DOUBLE) AS y, CAST(lag(n) OVER (PARTITION BY {cell} ORDER BY time_bin) AS DOUBLE) AS p FROM g),
    v AS (SELECT * FROM p WHERE p IS NOT NULL),
    k AS (SELECT {cell}, CASE WHEN count(*) >= 3 AND stddev_samp(y) > 0 AND stddev_samp(p) > 0
            THEN {_corr_sql('y', 'p')} END AS c FROM v GROUP BY 1)
    SELECT avg(c) AS stability_corr, avg(CASE WHEN c IS NULL THEN 1e0 ELSE 0e0 END) AS nan_stability,
      (SELECT avg(abs(y - p)) FROM v) AS stability_diff FROM k
    """


@query(
    "time_stability",
    "stability_corr:d nan_stability:d stability_diff:d",
    _stability_sql(_GRID, "user_id"),
)
def time_stability(spark, d):
    return resolution.time_stability(dense_cube_observed(spark, d), "user_id", "time_bin", "n")


@query(
    "time_stability_monthly",
    "stability_corr:d nan_stability:d stability_diff:d",
    _stability_sql(_MONTH_GRID, "o_custkey"),
)
def time_stability_monthly(spark, d):
    return resolution.time_stability(_month_grid(spark, d), "o_custkey", "time_bin", "n")


@query(
    "pooled_time_stability",
    "temporal_stability:d",
    f"""
    SELECT {_corr_sql('y', 'p')} AS temporal_stability FROM (
      SELECT CAST(n AS DOUBLE) AS y, CAST(lag(n) OVER (PARTITION BY user_id ORDER BY time_bin) AS DOUBLE) AS p
      FROM ({_GRID}) AS g) AS t WHERE p IS NOT NULL
    """,
)
def pooled_time_stability(spark, d):
    return resolution.pooled_stability(dense_cube_observed(spark, d), "user_id", "time_bin", "n")


_CELL_SQL = f"""
  SELECT o_custkey, count(*) FILTER (n > 0) AS active_bins,
    quantile_cont(CASE WHEN n > 0 THEN n END, 0.5) AS median_non_zero FROM ({_MONTH_GRID}) AS g GROUP BY 1
"""
for _metric, _expr in [
    ("active_bins", "active_bins"),
    ("median_non_zero", "median_non_zero"),
    ("event_intensity", "active_bins * median_non_zero"),
]:

    @query(
        f"{_metric}_per_cell",
        f"{_metric}_mean:d {_metric}_median:d",
        f"""
        SELECT avg({_expr}) AS {_metric}_mean, quantile_cont({_expr}, 0.5) AS {_metric}_median
        FROM ({_CELL_SQL}) AS c
        """,
    )
    def per_cell_metric(spark, d, _metric=_metric):
        return getattr(resolution, _metric)(_month_grid(spark, d), "o_custkey", "n")


# --- the sweep ----------------------------------------------------------------------------------

_SWEEP_COLS = (
    f"resolution:i freq:s {_STATS_COLS} entropy:d gini:d stability_corr:d nan_stability:d "
    "stability_diff:d active_bins_mean:d active_bins_median:d median_non_zero_mean:d "
    "median_non_zero_median:d event_intensity_mean:d event_intensity_median:d n_unique_cells:i "
    "mean_per_cell:d"
)


def sweep_sql(counts: str, min_events: int = 2) -> str:
    """Every metric on the dense grids of long counts (resolution, freq, cell, time_bin, n)."""
    k = "resolution, freq"
    return f"""
    WITH c AS ({counts}),
    a AS (SELECT {k}, cell FROM c GROUP BY ALL HAVING sum(n) >= {min_events}),
    b AS (SELECT DISTINCT {k}, time_bin FROM c),
    g AS (SELECT a.resolution, a.freq, a.cell, b.time_bin, coalesce(c.n, 0) AS n
          FROM a JOIN b ON a.resolution = b.resolution AND a.freq = b.freq
          LEFT JOIN c ON c.resolution = a.resolution AND c.freq = a.freq AND c.cell = a.cell
               AND c.time_bin = b.time_bin),
    st AS (SELECT {k}, {_stats_sql()} FROM g GROUP BY ALL),
    e AS (SELECT {k}, -sum(p * ln(p)) AS entropy FROM (
            SELECT {k}, n / CAST(sum(n) OVER (PARTITION BY {k}) AS DOUBLE) AS p FROM g) AS t WHERE p > 0 GROUP BY ALL),
    gi AS (SELECT {k}, 2 * sum(i * CAST(n AS DOUBLE)) / (count(*) * sum(CAST(n AS DOUBLE)))
             - (count(*) + 1) / CAST(count(*) AS DOUBLE) AS gini
           FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n) AS i FROM g) AS t GROUP BY ALL),
    p AS (SELECT {k}, cell, CAST(n AS DOUBLE) AS y,
            CAST(lag(n) OVER (PARTITION BY {k}, cell ORDER BY time_bin) AS DOUBLE) AS p FROM g),
    pc AS (SELECT {k}, cell, CASE WHEN count(p) >= 3 AND stddev_samp(y) FILTER (p IS NOT NULL) > 1e-6
              AND stddev_samp(p) > 1e-6
             THEN covar_samp(y, p) FILTER (p IS NOT NULL)
               / (stddev_samp(y) FILTER (p IS NOT NULL) * stddev_samp(p)) END AS r FROM p GROUP BY ALL),
    ts AS (SELECT {k}, avg(r) AS stability_corr, avg(CASE WHEN r IS NULL THEN 1e0 ELSE 0e0 END) AS nan_stability
           FROM pc GROUP BY ALL),
    td AS (SELECT {k}, avg(abs(y - p)) AS stability_diff FROM p WHERE p IS NOT NULL GROUP BY ALL),
    cl AS (SELECT {k}, cell, count(*) FILTER (n > 0) AS ab, quantile_cont(CASE WHEN n > 0 THEN n END, 0.5) AS mz,
             sum(n) AS tot FROM g GROUP BY ALL),
    ca AS (SELECT {k}, avg(ab) AS active_bins_mean, quantile_cont(ab, 0.5) AS active_bins_median,
             avg(mz) AS median_non_zero_mean, quantile_cont(mz, 0.5) AS median_non_zero_median,
             avg(ab * mz) AS event_intensity_mean, quantile_cont(ab * mz, 0.5) AS event_intensity_median,
             count(*) AS n_unique_cells, avg(tot) AS mean_per_cell FROM cl GROUP BY ALL)
    SELECT * FROM st JOIN e USING ({k}) JOIN gi USING ({k}) JOIN ts USING ({k})
      LEFT JOIN td USING ({k}) JOIN ca USING ({k})
    """


_FREQS = ["monthly", "weekly", "two_weekly"]
_CHAIN = {2: "o_custkey", 1: "c_nationkey", 0: "n_regionkey"}
_CHAIN_COUNTS = " UNION ALL ".join(
    f"SELECT {r} AS resolution, '{f}' AS freq, CAST({c} AS VARCHAR) AS cell, {sql_bin('o_orderdate', f)} AS time_bin, "
    f"count(*) AS n FROM ({PLACED_ORDERS}) AS p GROUP BY ALL"
    for r, c in _CHAIN.items()
    for f in _FREQS
)


def order_sweep_counts(spark, d):
    return resolution.sparse_counts(placed_orders(spark, d), "o_orderdate", _CHAIN, _FREQS)


@query("unpivoted_counts", "resolution:i freq:s cell:s time_bin:t n:i", _CHAIN_COUNTS)
def unpivoted_counts(spark, d):
    return order_sweep_counts(spark, d)


@query("resolution_sweep_orders", _SWEEP_COLS, sweep_sql(_CHAIN_COUNTS))
def resolution_sweep_orders(spark, d):
    return resolution.sweep(order_sweep_counts(spark, d))


_HEX = [0, 1, 2, 3]
_HEX_FREQS = ["daily", "weekly"]
_HEX_COUNTS = f"WITH p AS ({cells_sql(_HEX)}) " + " UNION ALL ".join(
    f"SELECT {r} AS resolution, '{f}' AS freq, cell_res{r} AS cell, {sql_bin('ts', f)} AS time_bin, "
    f"count(*) AS n FROM p GROUP BY ALL"
    for r in _HEX
    for f in _HEX_FREQS
)


def hex_sweep_counts(spark, d):
    placed = geo.with_cells(placed_events(spark, d), "lat", "lon", _HEX)
    return resolution.sparse_counts(placed, "ts", {r: f"cell_res{r}" for r in _HEX}, _HEX_FREQS)


@query("resolution_sweep_hex_cells", _SWEEP_COLS, sweep_sql(_HEX_COUNTS))
def resolution_sweep_hex_cells(spark, d):
    return resolution.sweep(hex_sweep_counts(spark, d))


def _norm(c: str) -> str:
    return f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9)"


def _best_sql(counts: str, min_rows: int, top: int) -> str:
    return f"""
    WITH r AS (SELECT * REPLACE (greatest(coalesce(stability_corr, 0), 0) AS stability_corr,
                 coalesce(stability_diff, 0) AS stability_diff) FROM ({sweep_sql(counts)}) AS s
               WHERE non_zero_share > 0.05 AND rows > {min_rows}),
    n AS (SELECT resolution, freq, rows, {_norm('entropy')} AS e, {_norm('non_zero_share')} AS z, {_norm('var')} AS v,
            {_norm('stability_corr')} AS c, {_norm('stability_diff')} AS d, {_norm('active_bins_median')} AS a,
            {_norm('median_non_zero_median')} AS m FROM r)
    SELECT resolution, freq, rows, 0.4 * e + 0.3 * z - 0.3 * v + 0.2 * d AS score_diff,
      0.4 * e + 0.3 * z - 0.3 * v + 0.2 * c AS score_corr, 0.6 * a + 0.4 * m AS score
    FROM n ORDER BY round(score, 9) DESC, resolution, freq LIMIT {top}
    """


_BEST_COLS = "resolution:i freq:s rows:i score_diff:d score_corr:d score:d"


@query("best_resolution_orders", _BEST_COLS, _best_sql(_CHAIN_COUNTS, 1000, 10))
def best_resolution_orders(spark, d):
    return resolution.best_choices(resolution.sweep(order_sweep_counts(spark, d)))


@query("composite_scores_hex_cells", _BEST_COLS, _best_sql(_HEX_COUNTS, 0, 100))
def composite_scores_hex_cells(spark, d):
    return resolution.composite_scores(resolution.usable(resolution.sweep(hex_sweep_counts(spark, d)), 0))


# --- describing columns -------------------------------------------------------------------------

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    m = f"(SELECT avg({v}) FROM lineitem)"
    qs = ", ".join(f"quantile_cont({v}, {p}) AS {k}" for k, p in resolution.DESCRIBE_QUANTILES.items())
    return f"""
    SELECT '{c}' AS "column", count({c}) AS count_clean, count(*) - count({c}) AS nan_count, min({v}) AS min, avg({v}) AS mean,
      max({v}) AS max, stddev_pop({v}) AS std, avg(pow({v} - {m}, 3)) / pow(var_pop({v}), 1.5e0) AS skewness,
      avg(pow({v} - {m}, 4)) / pow(var_pop({v}), 2) - 3 AS kurtosis, {qs} FROM lineitem
    """


@query(
    "describe_numeric",
    "column:s count_clean:i nan_count:i min:d mean:d max:d std:d skewness:d kurtosis:d "
    + " ".join(f"{q}:d" for q in resolution.DESCRIBE_QUANTILES),
    " UNION ALL ".join(_describe_sql(c) for c in _NUM),
)
def describe_numeric(spark, d):
    return resolution.describe_numeric(table(spark, d, "lineitem"), _NUM)


@query(
    "describe_with_nan",
    "column:s count_clean:i nan_count:i min:d mean:d max:d median:d",
    """
    SELECT 'l_quantity' AS "column", count(v) AS count_clean, count(*) - count(v) AS nan_count, min(v) AS min, avg(v) AS mean,
      max(v) AS max, quantile_cont(v, 0.5) AS median
    FROM (SELECT CASE WHEN l_orderkey % 3 = 1 THEN l_quantity END AS v FROM lineitem) AS t
    """,
)
def describe_with_nan(spark, d):
    gappy = F.when(F.col("l_orderkey") % 3 == 0, F.lit(float("nan"))).when(F.col("l_orderkey") % 3 == 1, F.col("l_quantity"))
    return resolution.describe_numeric(table(spark, d, "lineitem").select(gappy.alias("l_quantity")), ["l_quantity"])


_CAT = ["o_orderstatus", "o_orderpriority", "o_custkey"]


def _cat_sql(c: str) -> str:
    return f"""
    SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS nan_count,
      (SELECT CAST({c} AS VARCHAR) FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
      (SELECT count(*) FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS top_freq
    FROM orders
    """


@query(
    "describe_categorical",
    "column:s n_unique:i nan_count:i top:s top_freq:i",
    " UNION ALL ".join(_cat_sql(c) for c in _CAT),
)
def describe_categorical(spark, d):
    return resolution.describe_categorical(table(spark, d, "orders"), _CAT)
