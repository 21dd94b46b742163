"""Queries on data quality, merging decisions and risk scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcadence.operators import merging, quality, risk
from hexcadence.plans import audit, audit_tables
from hexcadence.workload.base import BROKEN_EVENTS, broken_events, query, sql_bin, table

# Line items with damage: missing flags, infinite ratios, many zeros.
_DAMAGED = """
  SELECT l_orderkey, l_linenumber, l_quantity, l_tax,
    CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS l_returnflag,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_linestatus END AS l_linestatus,
    CASE WHEN l_tax = 0 THEN CAST('inf' AS DOUBLE) ELSE l_extendedprice / l_tax END AS price_per_tax,
    CASE WHEN l_quantity > 45 THEN l_quantity ELSE 0 END AS bulk_quantity
  FROM lineitem
"""


def damaged(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_tax",
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("l_returnflag"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), F.col("l_linestatus")).alias(
            "l_linestatus"
        ),
        F.when(F.col("l_tax") == 0, float("inf"))
        .otherwise(F.try_divide("l_extendedprice", "l_tax"))
        .alias("price_per_tax"),
        F.when(F.col("l_quantity") > 45, F.col("l_quantity")).otherwise(0.0).alias("bulk_quantity"),
    )


_DAMAGED_COLS = [
    "l_orderkey",
    "l_linenumber",
    "l_quantity",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "price_per_tax",
    "bulk_quantity",
]
_DAMAGED_NUM = [c for c in _DAMAGED_COLS if c not in ("l_returnflag", "l_linestatus")]


def _per_column_sql(columns, expr: str, source: str = _DAMAGED) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {expr.format(c=c)} FROM ({source}) AS s" for c in columns
    )


@query(
    "table_overview",
    "column:s position:i n_rows:i n_columns:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, count(*) AS n_rows, 6 AS n_columns FROM events"
        for i, c in enumerate(["event_id", "ts", "user_id", "event_type", "value", "props"])
    ),
)
def table_overview(spark, d):
    return quality.overview(table(spark, d, "events"))


@query(
    "missing_analysis",
    "column:s nan_count:i nan_ratio:d flagged:b",
    _per_column_sql(
        _DAMAGED_COLS,
        "count(*) - count({c}) AS nan_count, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS nan_ratio, "
        "(count(*) - count({c})) / CAST(count(*) AS DOUBLE) > 0.5 AS flagged",
    ),
)
def missing_analysis(spark, d):
    return quality.missing_analysis(damaged(spark, d))


@query(
    "infinite_analysis",
    "column:s inf_count:i flagged:b",
    _per_column_sql(
        _DAMAGED_NUM,
        "count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS inf_count, "
        "count(*) FILTER (isinf(CAST({c} AS DOUBLE))) > 0 AS flagged",
    ),
)
def infinite_analysis(spark, d):
    return quality.infinite_analysis(damaged(spark, d))


_DUP_SQL = """
  SELECT '{scope}' AS scope, coalesce(sum(n - 1), 0) AS n_duplicates, sum(n) AS n_rows,
    sum(n - 1) / CAST(sum(n) AS DOUBLE) AS duplicate_ratio, sum(n - 1) / CAST(sum(n) AS DOUBLE) > 0.01 AS flagged
  FROM (SELECT count(*) AS n FROM conversations GROUP BY {keys}) AS g
"""


@query(
    "duplicate_analysis",
    "scope:s n_duplicates:i n_rows:i duplicate_ratio:d flagged:b",
    _DUP_SQL.format(scope="general", keys="conv_id, turn, role, text")
    + " UNION ALL "
    + _DUP_SQL.format(scope="grouped", keys="role, text"),
)
def duplicate_analysis(spark, d):
    return quality.duplicate_analysis(table(spark, d, "conversations"), ["role", "text"])


_SUMMARY_Q = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_SUMMARY_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_heavy"]
_HEAVY = "SELECT *, pow(o_totalprice / 1e5, 9e0) AS o_heavy FROM orders"


@query(
    "numeric_summary",
    "column:s count:i mean:d std:d min:d max:d skewness:d kurtosis:d skew_flag:b kurtosis_flag:b "
    + " ".join(f"{q}:d" for q in _SUMMARY_Q),
    _per_column_sql(
        _SUMMARY_COLS,
        "count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
        "skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, abs(skewness({c})) > 2 AS skew_flag, "
        "kurtosis({c}) > 10 AS kurtosis_flag, "
        + ", ".join(f"quantile_cont(CAST({{c}} AS DOUBLE), {p}) AS {k}" for k, p in _SUMMARY_Q.items()),
        _HEAVY,
    ),
)
def numeric_summary(spark, d):
    o = table(spark, d, "orders").withColumn("o_heavy", F.pow(F.col("o_totalprice") / 1e5, F.lit(9.0)))
    return quality.numeric_summary(o, _SUMMARY_Q, _SUMMARY_COLS)


_DOC_TEXTS = ["text", "lang", "source"]


@query(
    "categorical_summary",
    "column:s n_unique:i high_cardinality:b",
    _per_column_sql(
        _DOC_TEXTS, "count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) >= 50 AS high_cardinality", "SELECT * FROM documents"
    ),
)
def categorical_summary(spark, d):
    return quality.categorical_summary(table(spark, d, "documents"))


def _top_sql(c: str, direction: str, n: int, source: str) -> str:
    return f"""
    SELECT '{c}' AS "column", value, n, place, share FROM (
      SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n,
        row_number() OVER (ORDER BY count(*) {direction}, CAST({c} AS VARCHAR)) AS place,
        count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
      FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) AS t WHERE place <= {n}
    """


@query(
    "top_values",
    "column:s value:s n:i place:i share:d",
    " UNION ALL ".join(_top_sql(c, "DESC", 10, "documents") for c in _DOC_TEXTS),
)
def top_values(spark, d):
    return quality.top_values(table(spark, d, "documents"))


@query(
    "rare_values",
    "column:s value:s n:i place:i share:d",
    " UNION ALL ".join(_top_sql(c, "ASC", 5, "orders") for c in ["o_custkey", "o_orderpriority"]),
)
def rare_values(spark, d):
    return quality.top_values(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], 5, least=True)


@query(
    "zero_inflation",
    "column:s zero_ratio:d flagged:b",
    _per_column_sql(
        _DAMAGED_NUM,
        "avg(CASE WHEN {c} = 0 THEN 1e0 ELSE 0e0 END) AS zero_ratio, "
        "avg(CASE WHEN {c} = 0 THEN 1e0 ELSE 0e0 END) > 0.8 AS flagged",
    ),
)
def zero_inflation(spark, d):
    return quality.zero_inflation(damaged(spark, d))


_DATES = """
  SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS placed, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'open' END AS closed, o_orderpriority
  FROM orders
"""


def _date_sql(c: str) -> str:
    rates = ", ".join(
        f"avg(CASE WHEN try_strptime(v, '{f}') IS NOT NULL THEN 1e0 ELSE 0e0 END)"
        for f in ["%Y-%m-%d", "%d.%m.%Y", "%Y/%m/%d", "%d/%m/%Y"]
    )
    by_name = "true" if "date" in c else "false"
    return f"""
    SELECT '{c}' AS "column", success_ratio, {by_name} AS by_name, {by_name} OR success_ratio > 0.8 AS candidate
    FROM (SELECT greatest({rates}) AS success_ratio FROM (
      SELECT {c} AS v FROM ({_DATES}) AS d WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 100) AS f) AS r
    """


@query(
    "datetime_candidates",
    "column:s success_ratio:d by_name:b candidate:b",
    " UNION ALL ".join(_date_sql(c) for c in ["placed", "order_date", "closed", "o_orderpriority"]),
)
def datetime_candidates(spark, d):
    day = F.col("o_orderdate")
    o = table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format(day, "dd.MM.yyyy").alias("placed"),
        F.date_format(day, "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy/MM/dd")).otherwise("open").alias("closed"),
        "o_orderpriority",
    )
    return quality.datetime_candidates(o, "o_orderkey")


@query(
    "null_ratio",
    "n_rows:i n_null:i null_ratio:d",
    f"""
    SELECT count(*) AS n_rows, count(*) - count(l_returnflag) AS n_null,
      (count(*) - count(l_returnflag)) / CAST(count(*) AS DOUBLE) AS null_ratio FROM ({_DAMAGED}) AS s
    """,
)
def null_ratio(spark, d):
    return quality.null_ratio(damaged(spark, d), "l_returnflag")


@query(
    "aggregate_consistency",
    "l_orderkey:i computed_value:d2 stored_value:d2 difference:d2 relative_diff:d violation:b",
    """
    SELECT *, computed_value - stored_value AS difference, (computed_value - stored_value) / NULLIF(stored_value, 0) AS relative_diff,
      abs((computed_value - stored_value) / NULLIF(stored_value, 0)) > 0.02 AS violation
    FROM (SELECT l_orderkey, sum(l_extendedprice) AS computed_value FROM lineitem GROUP BY 1) c
    JOIN (SELECT o_orderkey AS l_orderkey, o_totalprice AS stored_value FROM orders) s USING (l_orderkey)
    """,
)
def aggregate_consistency(spark, d):
    stored = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return quality.aggregate_consistency(
        table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", stored, "o_totalprice", 0.02
    )


@query(
    "zscores",
    "event_id:i z_score:d outlier:b",
    """
    SELECT event_id, (value - m) / s AS z_score, abs((value - m) / s) >= 3 AS outlier
    FROM events CROSS JOIN (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) AS st
    """,
)
def zscores(spark, d):
    return quality.zscores(table(spark, d, "events"), "value")


@query(
    "time_integrity",
    "check:s issue_type:s value:d first_missing:t last_missing:t",
    """
    WITH s AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS b FROM orders),
    x AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 DAY)) AS m FROM s)
    SELECT 'time_gaps' AS "check", 'missing_time_periods' AS issue_type, count(*) AS value, min(m) AS first_missing,
      max(m) AS last_missing FROM x WHERE m NOT IN (SELECT b FROM s)
    """,
)
def time_integrity(spark, d):
    return quality.time_integrity(table(spark, d, "orders"), "o_orderdate", "daily")


@query(
    "range_assertions",
    "check:s value:d passed:b",
    f"""
    WITH e AS (SELECT *, year(ts) AS y, month(ts) AS m, hour(ts) AS h FROM ({BROKEN_EVENTS}) AS b)
    SELECT 'row_count' AS "check", count(*) AS value, count(*) >= 500000 AS passed FROM e
    UNION ALL SELECT 'geo_ratio', avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1e0 ELSE 0e0 END),
      avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1e0 ELSE 0e0 END) >= 0.45 FROM e
    UNION ALL SELECT 'min_year', min(y), min(y) >= 2001 FROM e UNION ALL SELECT 'max_year', max(y), max(y) <= 2035 FROM e
    UNION ALL SELECT 'min_hour', min(h), min(h) >= 0 FROM e UNION ALL SELECT 'max_hour', max(h), max(h) <= 24 FROM e
    UNION ALL SELECT 'min_month', min(m), min(m) >= 1 FROM e UNION ALL SELECT 'max_month', max(m), max(m) <= 12 FROM e
    """,
)
def range_assertions(spark, d):
    e = broken_events(spark, d).select(
        "latitude",
        "longitude",
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.hour("ts").alias("hour"),
    )
    return quality.range_assertions(e)


# --- merging ------------------------------------------------------------------------------------

_SPLIT = {"a": "year(o_orderdate) <= 1998", "b": "year(o_orderdate) >= 1997"}


def _halves(spark, d):
    o = table(spark, d, "orders")
    y = F.year("o_orderdate")
    a = o.where(y <= 1998)
    b = o.where(y >= 1997).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return a, b


def _profile_sql(c: str, conflict: str) -> str:
    return f"""
    SELECT '{c}' AS "column", ra AS n_rows_a, rb AS n_rows_b, ua AS n_unique_a, ub AS n_unique_b, ov AS overlap_rows,
      {conflict} AS type_conflict, greatest(ua, ub) / CAST(least(ua, ub) AS DOUBLE) > 10 AS cardinality_mismatch,
      ua / CAST(ra AS DOUBLE) AS uniqueness_a, ub / CAST(rb AS DOUBLE) AS uniqueness_b,
      ov / CAST(ua AS DOUBLE) AS overlap_vs_a, ov / CAST(ub AS DOUBLE) AS overlap_vs_b
    FROM (SELECT count(*) FILTER ({_SPLIT['a']}) AS ra, count(*) FILTER ({_SPLIT['b']}) AS rb,
            count(DISTINCT {c}) FILTER ({_SPLIT['a']}) AS ua, count(DISTINCT {c}) FILTER ({_SPLIT['b']}) AS ub,
            (SELECT count(*) FROM (SELECT {c} FROM orders WHERE {_SPLIT['a']} INTERSECT
               SELECT {c} FROM orders WHERE {_SPLIT['b']}) AS i) AS ov FROM orders) AS s
    """


@query(
    "merge_profile",
    "column:s n_rows_a:i n_rows_b:i n_unique_a:i n_unique_b:i overlap_rows:i type_conflict:b "
    "cardinality_mismatch:b uniqueness_a:d uniqueness_b:d overlap_vs_a:d overlap_vs_b:d",
    " UNION ALL ".join(
        _profile_sql(c, "true" if c == "o_custkey" else "false")
        for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    ),
)
def merge_profile(spark, d):
    return merging.pair_profile(*_halves(spark, d))


@query(
    "schema_compare",
    "pair:s column:s place:s",
    """
    WITH a AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS c),
    b AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_year']) AS c)
    SELECT 'first_vs_second' AS pair, coalesce(a.c, b.c) AS "column",
      CASE WHEN a.c IS NULL THEN 'only_in_b' WHEN b.c IS NULL THEN 'only_in_a' ELSE 'common' END AS place
    FROM a FULL OUTER JOIN b ON a.c = b.c WHERE (SELECT count(*) FROM orders) > 0
    """,
)
def schema_compare(spark, d):
    o = table(spark, d, "orders")
    second = o.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("o_year"))
    return merging.schema_compare({"first": o, "second": second})


_DECISION_COLS = "strategy:s reason:s join_key:s similarity:d confidence_merge:d confidence_append:d"


def _decision_sql(a: str, b: str, strategy: str, reason: str) -> str:
    """Decision on a known key; the strategy is stated by the case at hand, overlaps are computed."""
    return f"""
    WITH a AS (SELECT DISTINCT o_orderkey FROM orders WHERE {a}), b AS (SELECT DISTINCT o_orderkey FROM orders WHERE {b}),
    s AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb,
            (SELECT count(*) FROM a SEMI JOIN b USING (o_orderkey)) AS ov)
    SELECT '{strategy}' AS strategy, '{reason}' AS reason, 'o_orderkey' AS join_key, 1e0 AS similarity,
      0.4 + 0.4 * ov / greatest(na, nb) + 0.2 AS confidence_merge,
      0.4 + 0.4 * (1 - ov / greatest(na, nb)) + 0.2 AS confidence_append FROM s
    """


@query(
    "merge_decision_append",
    _DECISION_COLS,
    _decision_sql("year(o_orderdate) <= 1997", "year(o_orderdate) > 1997", "append", "datasets disjoint"),
)
def merge_decision_append(spark, d):
    o, y = table(spark, d, "orders"), F.year("o_orderdate")
    return merging.merge_decision(o.where(y <= 1997), o.where(y > 1997), "o_orderkey")


@query(
    "merge_decision_partial",
    _DECISION_COLS,
    _decision_sql("year(o_orderdate) <= 1998", "year(o_orderdate) >= 1997", "manual_review", "partial overlap"),
)
def merge_decision_partial(spark, d):
    o, y = table(spark, d, "orders"), F.year("o_orderdate")
    return merging.merge_decision(o.where(y <= 1998), o.where(y >= 1997), "o_orderkey")


@query(
    "merge_execute_append",
    "o_orderkey:i o_custkey:i o_totalprice:d2",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def merge_execute_append(spark, d):
    o, y = table(spark, d, "orders"), F.year("o_orderdate")
    a, b = o.where(y <= 1997), o.where(y > 1997)
    return merging.execute_decision(a, b, merging.merge_decision(a, b, "o_orderkey"))


_TABLES_SQL = {
    "early": ("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "SELECT * FROM orders WHERE year(o_orderdate) <= 1997"),
    "late": ("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "SELECT * FROM orders WHERE year(o_orderdate) > 1997"),
    "scored": (
        "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority o_score",
        "SELECT *, o_orderkey % 7 AS o_score FROM orders WHERE year(o_orderdate) <= 1997 AND o_orderkey % 20 != 0",
    ),
    "narrow": ("o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders"),
    "recent": (
        "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey) FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998",
    ),
    "status": ("s_code s_rows", "SELECT o_orderstatus AS s_code, count(*) AS s_rows FROM orders GROUP BY 1"),
}
_ALL_PAIRS_SQL = f"""
  WITH u AS ({" UNION ALL ".join(
      f"SELECT {i} AS t, '{t}' AS file, '{c}' AS c, CAST({c} AS VARCHAR) AS val, typeof({c}) AS kind FROM ({sql}) AS x"
      for i, (t, (columns, sql)) in enumerate(_TABLES_SQL.items()) for c in columns.split())}),
  v AS MATERIALIZED (SELECT t, file, c, val, max(kind) AS kind, count(*) AS n FROM u GROUP BY 1, 2, 3, 4),
  k AS (SELECT t, file, c, max(kind) AS kind, sum(n) AS n_rows, count(val) AS n_unique, count(*) AS n_keys FROM v GROUP BY 1, 2, 3),
  files AS (SELECT DISTINCT t, file FROM k),
  pairs AS (SELECT a.t AS ta, b.t AS tb, a.file AS file_a, b.file AS file_b FROM files a JOIN files b ON a.t < b.t),
  shared AS (SELECT a.t AS ta, b.t AS tb, a.c, count(*) AS overlap, sum(CASE WHEN a.val IS NOT NULL THEN a.n * b.n ELSE 0 END) AS matches
    FROM v a JOIN v b ON a.c = b.c AND a.val IS NOT DISTINCT FROM b.val AND a.t < b.t GROUP BY 1, 2, 3),
  sides AS (SELECT p.*, x.c, max(x.kind) FILTER (x.t = p.ta) AS kind_a, max(x.kind) FILTER (x.t = p.tb) AS kind_b FROM pairs p JOIN k x ON x.t IN (p.ta, p.tb) GROUP BY ALL),
  shape AS (SELECT ta, tb, file_a, file_b, count(*) FILTER (kind_b IS NULL) AS missing, count(*) FILTER (kind_a IS NULL) AS added, count(*) FILTER (kind_a != kind_b) AS changed FROM sides GROUP BY ALL),
  alike AS (SELECT *, greatest(0, 1 - CAST(missing + added + changed AS DOUBLE) / (2 * (missing + added) + greatest(1, changed))) AS similarity FROM shape),
  keys AS (SELECT s.ta, s.tb, s.c, a.n_rows * 1e0 * b.n_rows AS product, coalesce(o.matches, 0) AS matches, a.n_keys / CAST(a.n_rows AS DOUBLE) AS ua, b.n_keys / CAST(b.n_rows AS DOUBLE) AS ub,
      coalesce(o.overlap, 0) / CAST(a.n_keys AS DOUBLE) AS va, coalesce(o.overlap, 0) / CAST(b.n_keys AS DOUBLE) AS vb, least(ua, ub) AS score,
      greatest(a.n_unique, b.n_unique) > 10 * least(a.n_unique, b.n_unique) AND least(a.n_unique, b.n_unique) > 0 AS uneven
    FROM sides s JOIN k a ON a.t = s.ta AND a.c = s.c JOIN k b ON b.t = s.tb AND b.c = s.c LEFT JOIN shared o ON o.ta = s.ta AND o.tb = s.tb AND o.c = s.c WHERE kind_a = kind_b),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ta, tb ORDER BY c = 'o_orderkey' AND score > 0.9e0 DESC, score DESC, c) AS place FROM keys WHERE NOT uneven AND score > 0) AS x WHERE place = 1),
  judged AS (SELECT a.*, b.*, CASE WHEN c IS NULL THEN 'no valid join key' WHEN missing > 0 THEN 'schema mismatch' WHEN va < 0.01e0 AND vb < 0.01e0 THEN 'datasets disjoint'
      WHEN va > 0.8e0 AND vb > 0.8e0 AND matches > 5e7 THEN 'join explosion risk' WHEN va > 0.8e0 AND vb > 0.8e0 THEN 'strong overlap' ELSE 'partial overlap' END AS reason
    FROM alike a LEFT JOIN best b USING (ta, tb))
  SELECT file_a, file_b, CASE WHEN reason IN ('schema mismatch', 'join explosion risk') THEN 'reject' WHEN reason = 'datasets disjoint' THEN 'append'
      WHEN reason = 'strong overlap' THEN 'merge' ELSE 'manual_review' END AS strategy, reason, c AS join_key, matches AS join_rows, similarity,
    0.4e0 * least(ua, ub) + 0.2e0 * similarity + 0.4e0 * least(va, vb) AS confidence_merge, 0.4e0 * least(ua, ub) + 0.2e0 * similarity + 0.4e0 * (1 - least(va, vb)) AS confidence_append
  FROM judged
"""


@query(
    "merge_decisions_all_pairs",
    "file_a:s file_b:s strategy:s reason:s join_key:s join_rows:i similarity:d confidence_merge:d confidence_append:d",
    _ALL_PAIRS_SQL,
)
def merge_decisions_all_pairs(spark, d):
    """Six tables, fifteen pairs: all strategies, renamed, missing, added and retyped columns."""
    o, y = table(spark, d, "orders"), F.year("o_orderdate")
    return merging.merge_decisions(
        {
            "early": o.where(y <= 1997),
            "late": o.where(y > 1997),
            "scored": o.where((y <= 1997) & (F.col("o_orderkey") % 20 != 0)).withColumn("o_score", F.col("o_orderkey") % 7),
            "narrow": o.select("o_orderkey", "o_totalprice"),
            "recent": o.where(y.between(1997, 1998)).withColumn("o_custkey", F.col("o_custkey").cast("string")),
            "status": o.groupBy(F.col("o_orderstatus").alias("s_code")).agg(F.count(F.lit(1)).alias("s_rows")),
        },
        "o_orderkey",
    )


# --- risk ---------------------------------------------------------------------------------------

# One finding per user and week with less than average activity, and per missing order day.
_FINDINGS = f"""
  SELECT 'z_score' AS "check", 'outlier' AS issue_type, CAST(user_id AS VARCHAR) AS "column",
    (n - avg(n) OVER ()) / stddev_samp(n) OVER () AS value
  FROM (SELECT user_id, {sql_bin('ts', 'weekly')} AS w, count(*) AS n FROM events GROUP BY 1, 2) AS c
  UNION ALL
  SELECT 'time_gaps', 'missing_time_periods', event_type, CAST(count(*) / 100.0 AS DOUBLE) FROM events GROUP BY event_type
  UNION ALL
  SELECT 'cross_resolution', 'aggregation_mismatch', o_orderpriority, avg(o_totalprice) / 1e6 FROM orders GROUP BY o_orderpriority
"""
_SCORED = f"""
  WITH f AS ({_FINDINGS}),
  s AS (SELECT *, CASE WHEN "check" = 'time_gaps' AND abs(value) >= 1 THEN 'high'
      WHEN "check" = 'cross_resolution' AND abs(value) >= 0.02 THEN 'medium'
      WHEN "check" = 'z_score' AND abs(value) >= 3 THEN 'high' ELSE 'low' END AS severity FROM f)
  SELECT *, CAST(floor(least(
      CASE severity WHEN 'low' THEN 5e0 WHEN 'medium' THEN 15e0 WHEN 'high' THEN 35e0 ELSE 70e0 END
      * CASE "check" WHEN 'cross_resolution' THEN 1.2e0 WHEN 'z_score' THEN 0.9e0 ELSE 1e0 END
      * CASE issue_type WHEN 'missing_time_periods' THEN 1.2e0 WHEN 'aggregation_mismatch' THEN 1.3e0 ELSE 1e0 END
      * CASE WHEN value <= 1 THEN 1e0 WHEN value <= 5 THEN 1.2e0 WHEN value <= 20 THEN 1.5e0 WHEN value <= 100 THEN 2e0
             ELSE 2.5e0 END, 120e0)) AS BIGINT) AS points FROM s
"""


def findings(spark, d):
    from hexcadence.functions import timefn as T

    weekly = (
        table(spark, d, "events").groupBy("user_id", T.bin_start("ts", "weekly").alias("w")).agg(F.count("*").alias("n"))
    )
    z = quality.zscores(weekly, "n").select(
        F.lit("z_score").alias("check"),
        F.lit("outlier").alias("issue_type"),
        F.col("user_id").cast("string").alias("column"),
        F.col("z_score").alias("value"),
    )
    gaps = (
        table(spark, d, "events")
        .groupBy("event_type")
        .agg((F.count("*") / F.lit(100.0)).alias("value"))
        .select(
            F.lit("time_gaps").alias("check"),
            F.lit("missing_time_periods").alias("issue_type"),
            F.col("event_type").alias("column"),
            "value",
        )
    )
    sums = (
        table(spark, d, "orders")
        .groupBy("o_orderpriority")
        .agg((F.avg("o_totalprice") / 1e6).alias("value"))
        .select(
            F.lit("cross_resolution").alias("check"),
            F.lit("aggregation_mismatch").alias("issue_type"),
            F.col("o_orderpriority").alias("column"),
            "value",
        )
    )
    return z.unionByName(gaps).unionByName(sums)


def scored_findings(spark, d):
    return risk.with_points(risk.with_severity(findings(spark, d)))


@query("finding_points", "check:s issue_type:s column:s value:d severity:s points:i", _SCORED)
def finding_points(spark, d):
    return scored_findings(spark, d)


@query(
    "risk_summary",
    "total_score:i finding_count:i risk_level:s",
    f"""
    SELECT sum(points) AS total_score, count(*) AS finding_count, CASE WHEN sum(points) >= 200 THEN 'critical'
      WHEN sum(points) >= 120 THEN 'high' WHEN sum(points) >= 60 THEN 'medium' WHEN sum(points) >= 20 THEN 'low'
      ELSE 'ok' END AS risk_level FROM ({_SCORED}) AS s
    """,
)
def risk_summary(spark, d):
    return risk.risk_summary(scored_findings(spark, d))


@query(
    "top_findings",
    "check:s column:s points:i",
    f'SELECT "check", "column", points FROM ({_SCORED}) AS s ORDER BY points DESC, "check", "column" LIMIT 5',
)
def top_findings(spark, d):
    return risk.top_findings(scored_findings(spark, d))


# --- check runner -------------------------------------------------------------------------------


def _finding_sql(check: str, metric: str, limit: float, columns, expr: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", '{c}' AS \"column\", '{metric}' AS metric, CAST({expr.format(c=c)} AS DOUBLE) AS value, "
        f"{limit} AS lim FROM ({_DAMAGED}) AS s"
        for c in columns
    )


_AUDIT_SQL = " UNION ALL ".join(
    [
        _finding_sql("missing", "nan_ratio", 0.5, _DAMAGED_COLS, "(count(*) - count({c})) / CAST(count(*) AS DOUBLE)"),
        _finding_sql("infinite", "inf_count", 0, _DAMAGED_NUM, "count(*) FILTER (isinf(CAST({c} AS DOUBLE)))"),
        _finding_sql("zero_inflation", "zero_ratio", 0.8, _DAMAGED_NUM, "avg(CASE WHEN {c} = 0 THEN 1e0 ELSE 0e0 END)"),
        _finding_sql("cardinality", "n_unique", 49, ["l_returnflag", "l_linestatus"], "count(DISTINCT {c})"),
        f"""SELECT 'duplicates', 'all', 'duplicate_ratio', sum(n - 1) / CAST(sum(n) AS DOUBLE), 0.01
        FROM (SELECT count(*) AS n FROM ({_DAMAGED}) AS s GROUP BY {', '.join(_DAMAGED_COLS)}) AS g""",
    ]
)


@query(
    "audit_damaged_table",
    "check:s column:s metric:s value:d flagged:b",
    f"SELECT *, value > lim AS flagged FROM ({_AUDIT_SQL}) AS f",
)
def audit_damaged_table(spark, d):
    checks = ["missing", "infinite", "zero_inflation", "cardinality", "duplicates"]
    return audit.run_checks(damaged(spark, d), checks)


@query(
    "recommended_actions",
    "action:s column:s",
    """
    SELECT * FROM (VALUES ('impute_nan', 'l_linestatus'), ('impute_inf', 'price_per_tax'),
      ('handle_zero_inflation', 'bulk_quantity')) AS v(action, "column")
    WHERE (SELECT count(*) FROM lineitem) > 0
    """,
)
def recommended_actions(spark, d):
    checks = ["missing", "infinite", "zero_inflation", "cardinality", "duplicates"]
    return audit.recommend(audit.run_checks(damaged(spark, d), checks))


# --- several tables at once ----------------------------------------------------------------------------


def audited_tables(spark, d):
    """Events with broken places, orders with text days, gaps and infinities, customers without some keys, and repeated rows."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return {
        "events": broken_events(spark, d).select("event_id", "ts", "event_type", "value", "latitude", "longitude"),
        "orders": o.select(
            "o_orderkey", F.col("o_custkey").alias("custkey"), F.when(F.dayofmonth("o_orderdate") != 13, F.col("o_orderdate")).alias("day"),
            F.to_date("o_orderdate").cast("string").alias("day_text"), F.when(key % 10 < 3, F.col("o_totalprice")).alias("price"),
            F.when(key % 50 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice") * F.col("o_totalprice")).alias("square"),
            F.when(key % 11 == 0, 1).otherwise(0).alias("flag"),
        ),
        "customers": table(spark, d, "customer").where("c_custkey % 10 != 3").select(F.col("c_custkey").alias("custkey"), "c_name"),
        "lines": table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("day")),
    }


_AUDITED_SQL = {
    "events": f"SELECT event_id, ts, event_type, value, latitude, longitude FROM ({BROKEN_EVENTS}) AS b",
    "orders": """SELECT o_orderkey, o_custkey AS custkey, CASE WHEN day(o_orderdate) != 13 THEN o_orderdate END AS day, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day_text,
        CASE WHEN o_orderkey % 10 < 3 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 50 = 0 THEN CAST('inf' AS DOUBLE) ELSE o_totalprice * o_totalprice END AS square,
        CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS flag FROM orders""",
    "customers": "SELECT c_custkey AS custkey, c_name FROM customer WHERE c_custkey % 10 != 3",
    "lines": "SELECT l_returnflag, l_linestatus, l_quantity AS quantity, l_shipdate AS day FROM lineitem",
}
_AUDITED_KINDS = {
    "events": {"event_id": "number", "ts": "time", "event_type": "text", "value": "float", "latitude": "float", "longitude": "float"},
    "orders": {"o_orderkey": "number", "custkey": "number", "day": "time", "day_text": "text", "price": "float", "square": "float", "flag": "number"},
    "customers": {"custkey": "number", "c_name": "text"},
    "lines": {"l_returnflag": "text", "l_linestatus": "text", "quantity": "float", "day": "time"},
}


def _audited_sql() -> str:
    heads = ", ".join(f"t_{t} AS MATERIALIZED ({sql})" for t, sql in _AUDITED_SQL.items())
    rows, spans = [], []

    def add(t, check, column, metric, value, bad, other="NULL", source=None):
        rows.append(
            f"SELECT '{t}' AS \"table\", {other} AS other, '{check}' AS \"check\", '{column}' AS \"column\", '{metric}' AS metric, v AS value, coalesce({bad}, false) AS flagged "
            f"FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source or f't_{t}'}) AS x"
        )

    for t, kinds in _AUDITED_KINDS.items():
        for c, kind in kinds.items():
            nan = f" OR isnan({c})" if kind == "float" else ""
            add(t, "missing", c, "missing_ratio", f"count(*) FILTER ({c} IS NULL{nan}) / nullif(CAST(count(*) AS DOUBLE), 0)", "v > 0.5")
            if kind == "float":
                add(t, "infinite", c, "inf_count", f"count(*) FILTER (isinf({c}))", "v > 0")
            if kind in ("float", "number"):
                add(t, "zero_inflation", c, "zero_ratio", f"count(*) FILTER ({c} = 0) / nullif(CAST(count(*) AS DOUBLE), 0)", "v > 0.8")
                good = f"FILTER (isfinite(CAST({c} AS DOUBLE)))"
                add(t, "skewness", c, "skewness", f"skewness({c}) {good}", "abs(v) > 2")
                add(t, "kurtosis", c, "kurtosis", f"kurtosis({c}) {good}", "v > 10")
            if kind == "text":
                formats = "['%Y-%m-%d', '%d.%m.%Y', '%Y/%m/%d', '%d/%m/%Y', '%Y-%m-%d %H:%M:%S']"
                add(t, "datetime", c, "parse_ratio", f"count(try_strptime({c}, {formats})) / nullif(CAST(count({c}) AS DOUBLE), 0)", "v >= 0.8")
            if kind == "time":
                days = f"date_diff('day', min(CAST({c} AS DATE)), max(CAST({c} AS DATE))) + 1"
                add(t, "time_range", c, "n_days", days, "false")
                add(t, "time_gaps", c, "missing_days", f"{days} - count(DISTINCT CAST({c} AS DATE))", "v > 0")
                spans.append((t, c, f"(SELECT min(CAST({c} AS DATE)) AS low, max(CAST({c} AS DATE)) AS high FROM t_{t})"))
        add(t, "duplicates", "all", "duplicate_ratio", f"1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM t_{t}) AS y) / CAST(count(*) AS DOUBLE)", "v > 0.01")
    for c, limit in (("latitude", 90), ("longitude", 180)):
        add("events", "geo_range", c, "outside_ratio", f"count(*) FILTER (abs({c}) > {limit}) / CAST(count({c}) AS DOUBLE)", "v > 0")
    add(
        "events", "geo_duplicates", "latitude,longitude", "duplicate_ratio", "1 - count(*) / CAST(sum(k) AS DOUBLE)", "v > 0.01",
        source="(SELECT latitude, longitude, count(*) AS k FROM t_events WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2) AS y",
    )
    for t, other in (("orders", "customers"), ("customers", "orders")):
        keys = f"(SELECT DISTINCT custkey FROM t_{t})"
        add(t, "key_overlap", "custkey", "found_ratio", f"count(*) FILTER (custkey IN (SELECT custkey FROM t_{other})) / CAST(count(*) AS DOUBLE)", "v < 1", f"'{other}'", f"{keys} AS y")
    for i, (t, c, x) in enumerate(spans):
        for u, e, y in spans[i + 1 :]:
            shared = "greatest(0, date_diff('day', greatest(a.low, b.low), least(a.high, b.high)) + 1)"
            shorter = "least(date_diff('day', a.low, a.high), date_diff('day', b.low, b.high)) + 1"
            add(t, "time_overlap", f"{c},{e}", "shared_ratio", f"{shared} / CAST({shorter} AS DOUBLE)", "v = 0", f"'{u}'", f"{x} AS a CROSS JOIN {y} AS b")
    return f"WITH {heads} " + " UNION ALL ".join(rows)


_ACTIONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in audit.ACTION_OF_CHECK.items()) + "}"


@query("audit_many_tables", "table:s other:s check:s column:s metric:s value:d flagged:b", _audited_sql())
def audit_many_tables(spark, d):
    return audit_tables.audit(audited_tables(spark, d))


@query(
    "actions_many_tables",
    "table:s action:s column:s",
    f"""SELECT "table", {_ACTIONS}["check"] AS action, "column" FROM ({_audited_sql()}) AS f WHERE flagged AND {_ACTIONS}["check"] IS NOT NULL""",
)
def actions_many_tables(spark, d):
    """Cleaning actions that answer the flagged findings, text columns that hold dates among them."""
    found = audit_tables.audit(audited_tables(spark, d))
    answered = found.where(F.col("check").isin(list(audit.ACTION_OF_CHECK)))
    return audit.recommend(answered, keep=["table"])
