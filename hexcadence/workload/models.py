"""Queries on splits, preparation and MLlib models (orders per nation and week as the series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcadence.functions.permute import HALF_ROUNDS, round_keys
from hexcadence.operators import evaluation, modelling, splits
from hexcadence.operators.modelling import SEED
from hexcadence.plans import forecast
from hexcadence.workload.base import placed_orders, query, sql_bin, table
from hexcadence.workload.cleaning import hash_sql

_WEEKLY = f"SELECT o_orderkey, o_custkey, o_totalprice, {sql_bin('o_orderdate', 'weekly')} AS time_bin FROM orders"


def weekly_orders(spark, d):
    from hexcadence.operators.timebin import with_bin

    return with_bin(table(spark, d, "orders"), "o_orderdate", "weekly")


_POS = f"""
  SELECT w.*, s.pos, s.n FROM ({_WEEKLY}) w JOIN (
    SELECT time_bin, coalesce(sum(k) OVER (ORDER BY time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
      sum(k) OVER () AS n FROM (SELECT time_bin, count(*) AS k FROM ({_WEEKLY}) AS c GROUP BY 1) AS b) s USING (time_bin)
"""


@query(
    "temporal_split_bins",
    "o_orderkey:i split:s",
    f"SELECT o_orderkey, CASE WHEN pos < floor(n * 0.7e0) THEN 'train' ELSE 'test' END AS split FROM ({_POS}) AS p",
)
def temporal_split_bins(spark, d):
    return splits.temporal_split(weekly_orders(spark, d), "time_bin")


_GAPS = f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 != 0 THEN time_bin END AS time_bin FROM ({_WEEKLY}) AS w"


@query(
    "temporal_split_null_bins",
    "o_orderkey:i split:s",
    f"""
    SELECT g.o_orderkey, CASE WHEN pos < floor(n * 0.7e0) THEN 'train' ELSE 'test' END AS split FROM ({_GAPS}) g JOIN (
      SELECT time_bin, coalesce(sum(k) OVER (ORDER BY time_bin NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
        sum(k) OVER () AS n FROM (SELECT time_bin, count(*) AS k FROM ({_GAPS}) AS c GROUP BY 1) AS b) s
      ON s.time_bin IS NOT DISTINCT FROM g.time_bin
    """,
)
def temporal_split_null_bins(spark, d):
    gaps = F.when(F.col("o_orderkey") % 5 != 0, F.col("time_bin"))
    return splits.temporal_split(weekly_orders(spark, d).withColumn("time_bin", gaps), "time_bin")


_VAL = (1 - 0.7) / 2


@query(
    "temporal_split_exact_rows",
    "o_orderkey:i split:s",
    f"""
    SELECT o_orderkey, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * {_VAL!r}) THEN 'val'
      ELSE 'test' END AS split FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY time_bin, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM ({_WEEKLY}) AS w) AS p
    """,
)
def temporal_split_exact_rows(spark, d):
    return splits.temporal_split(
        weekly_orders(spark, d), "time_bin", validation=True, exact_rows=True, tie_keys=["o_orderkey"]
    )


@query(
    "expanding_folds",
    "fold:i time_bin:t role:s",
    f"""
    WITH b AS (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS i, count(*) OVER () AS n
               FROM (SELECT DISTINCT time_bin FROM ({_WEEKLY}) AS w) AS x),
    f AS (SELECT *, n - (6 - fold) * (n // 6) AS s, n // 6 AS z FROM b CROSS JOIN (SELECT unnest(range(1, 6)) AS fold) r)
    SELECT * FROM (SELECT fold, time_bin, CASE WHEN i < s - 2 THEN 'train' WHEN i >= s AND i < s + z THEN 'test' END AS role FROM f) AS t
    WHERE role IS NOT NULL
    """,
)
def expanding_folds(spark, d):
    return splits.expanding_folds(weekly_orders(spark, d), "time_bin", n_splits=5, gap=2)


@query(
    "group_folds",
    "o_orderkey:i fold:i is_test_1:b is_test_2:b",
    f"""
    SELECT o_orderkey, {hash_sql('o_custkey')} % 5 AS fold,
      {hash_sql('o_custkey', seed=43)} / {float(1 << 60)!r} < 0.2e0 AS is_test_1,
      {hash_sql('o_custkey', seed=44)} / {float(1 << 60)!r} < 0.2e0 AS is_test_2 FROM orders
    """,
)
def group_folds(spark, d):
    return splits.group_shuffle(splits.group_folds(table(spark, d, "orders"), "o_custkey", 5), "o_custkey", 2)


@query(
    "stratified_holdout",
    "event_id:i event_type:s is_holdout:b",
    f"""
    SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql('event_id')})
      <= round(0.2e0 * count(*) OVER (PARTITION BY event_type)) AS is_holdout FROM events
    """,
)
def stratified_holdout(spark, d):
    return splits.stratified_holdout(table(spark, d, "events"), "event_id", "event_type")


@query(
    "standardised_features",
    "o_orderkey:i o_totalprice:d",
    f"""
    WITH s AS (SELECT *, CASE WHEN pos < floor(n * 0.7e0) THEN 'train' ELSE 'test' END AS split FROM ({_POS}) AS p),
    m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS b FROM s WHERE split = 'train')
    SELECT o_orderkey, (o_totalprice - a) / b AS o_totalprice FROM s CROSS JOIN m
    """,
)
def standardised_features(spark, d):
    s = splits.temporal_split(weekly_orders(spark, d), "time_bin")
    stats = modelling.scaler_stats(s.where(F.col("split") == "train"), ["o_totalprice"])
    return modelling.standardise(s, stats, ["o_totalprice"])


_RARE = "SELECT *, CAST(o_totalprice > 400000 AS INTEGER) AS y FROM orders"


@query(
    "class_weights",
    "mode:s y:i weight:d",
    f"""
    WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM ({_RARE}) AS r)
    SELECT 'balanced' AS mode, 0 AS y, n / (2 * (n - p)) AS weight FROM c UNION ALL SELECT 'balanced', 1, n / (2 * p) FROM c
    UNION ALL SELECT 'ratio', 0, 1 FROM c UNION ALL SELECT 'ratio', 1, least((n - p) / greatest(p, 1), 10) FROM c
    """,
)
def class_weights(spark, d):
    o = table(spark, d, "orders").withColumn("y", (F.col("o_totalprice") > 400000).cast("int"))
    both = [modelling.class_weights(o, "y", m).withColumn("mode", F.lit(m)) for m in ("balanced", "ratio")]
    return both[0].unionByName(both[1])


# --- models: checked by row counts here and by their quality in the tests -----------------------

FEATURES = [
    "lag_1",
    "lag_2",
    "lag_4",
    "lag_8",
    "roll_mean_4",
    "roll_mean_8",
    "roll_sum_4",
    "roll_sum_8",
    "roll_std_4",
    "roll_std_8",
    "zero_streak_prev",
    "month_sin",
    "month_cos",
]


def model_data(spark, d, validation=False):
    o = placed_orders(spark, d)
    feats = forecast.feature_table(o, "c_nationkey", "o_orderdate", "weekly", target="n", cyclic=True)
    busy = feats.withColumn("label", (F.col("n") >= F.col("roll_mean_8")).cast("int"))
    keyed = busy.withColumn("row_id", F.xxhash64("c_nationkey", "time_bin"))
    keys = ["row_id", "c_nationkey"]
    return modelling.prepare(keyed, FEATURES, "label", "time_bin", clip={"zero_streak_prev": 10}, keys=keys, validation=validation)


@query("logistic_forecast", "row_id:i y_true:i y_pred:i y_proba:d")
def logistic_forecast(spark, d):
    data = model_data(spark, d)
    return modelling.predict(modelling.fit_logistic(data), data.test, "label", ["row_id"])


@query("boosted_forecast", "row_id:i y_true:i y_pred:i y_proba:d")
def boosted_forecast(spark, d):
    data = model_data(spark, d)
    model = modelling.fit(data.train, FEATURES, modelling.boosted("label", maxIter=20, stepSize=0.2))
    return modelling.predict(model, data.test, "label", ["row_id"])


@query("logistic_coefficients", "feature:s coef:d effect:s odds_ratio:d importance:d")
def logistic_coefficients(spark, d):
    data = model_data(spark, d)
    return modelling.coefficient_table(modelling.fit_logistic(data), FEATURES, spark)


@query("tree_importance", "feature:s importance:d rank:d")
def tree_importance(spark, d):
    data = model_data(spark, d)
    model = modelling.fit(data.train, FEATURES, modelling.boosted("label", maxIter=10, stepSize=0.2))
    return modelling.importance_table(model, FEATURES, spark)


def _permuted_sql(repeats: int) -> str:
    """Places by the formula, applied again to those beyond the last row until none is left."""
    parts = []
    for r in range(repeats):
        keys = ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT, 'c': {c}::BIGINT}}" for a, b, c in round_keys(SEED + r))
        parts.append(f"SELECT {r} AS repeat, [{keys}] AS keys")
    mixed = lambda d, k: f"(({d} * {k}.a + {k}.b) % 2147483647 * (({d} * {k}.a + {k}.b) % 2147483647) + {k}.c) % 2147483647"
    rounds = ""
    left, right = "l0", "r0"
    for i in range(HALF_ROUNDS):
        if i % 2 == 0:
            rounds += f", ({left} + {mixed(right, f'keys[{i + 1}]')}) % high AS l{i + 1}"
            left = f"l{i + 1}"
        else:
            rounds += f", ({right} + {mixed(left, f'keys[{i + 1}]')}) % wide AS r{i + 1}"
            right = f"r{i + 1}"
    once = lambda source, columns: f"SELECT {columns}, spot // wide AS l0, spot % wide AS r0{rounds}, {left} * wide + {right} AS next FROM {source}"
    return f"""
    WITH RECURSIVE numbered AS MATERIALIZED (
      SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n,
        CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS wide, (n + wide - 1) // wide AS high FROM orders),
    seeds AS ({' UNION ALL '.join(parts)}),
    walk(i, n, wide, high, repeat, keys, spot) AS (
      SELECT i, n, wide, high, repeat, keys, next FROM ({once('(SELECT *, i AS spot FROM numbered CROSS JOIN seeds) AS s', '*')}) AS x
      UNION ALL
      SELECT i, n, wide, high, repeat, keys, next FROM ({once('walk', '*')} WHERE spot >= n) AS y
    )
    SELECT t.o_orderkey, m.repeat, s.o_orderkey AS from_orderkey, s.o_totalprice AS moved_price
    FROM walk m JOIN numbered s ON s.i = m.i JOIN numbered t ON t.i = m.spot WHERE m.spot < m.n
    """


@query("permuted_values", "o_orderkey:i repeat:i from_orderkey:i moved_price:d2", _permuted_sql(2))
def permuted_values(spark, d):
    """Prices of all orders, dealt out anew by two keyed permutations."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    rows = modelling.permuted_rows(orders, ["o_orderkey"], ["o_orderkey", "o_totalprice"], repeats=2)
    return rows.select("o_orderkey", F.explode("moved").alias("m")).select(
        "o_orderkey", "m.repeat", F.col("m.values.o_orderkey").alias("from_orderkey"), F.col("m.values.o_totalprice").alias("moved_price")
    )


@query("permutation_importance", "feature:s importance_mean:d importance_std:d")
def permutation_importance(spark, d):
    data = model_data(spark, d)
    model = modelling.fit_logistic(data)
    return modelling.permutation_importance(model, data.test, FEATURES, "label", ["c_nationkey", "time_bin"])


@query("stacked_models", "row_id:i y_true:i y_stacked:i")
def stacked_models(spark, d):
    data = model_data(spark, d, validation=True)
    models = {
        "logistic": modelling.fit_logistic(data),
        "boosted": modelling.fit(data.train, FEATURES, modelling.boosted("label", maxIter=10, stepSize=0.2)),
    }

    def predictions(rows):
        first, second = (
            modelling.predict(m, rows, "label", ["row_id"]).withColumn("model", F.lit(name)) for name, m in models.items()
        )
        return first.unionByName(second)

    return modelling.stack_models(predictions(data.validation), predictions(data.test), ["row_id"], list(models))


@query("threshold_refit", "model:s C:d best_t:d precision:d recall:d f1:d f2:d roc_auc:d pr_auc:d")
def threshold_refit(spark, d):
    data = model_data(spark, d)
    return modelling.refit_top(data, [{"C": 0.1}, {"C": 1.0}], "row_id")


@query("pca_components", "component:i variance_ratio:d cumulative:d")
def pca_components(spark, d):
    return modelling.pca_report(table(spark, d, "embeddings"), "embedding", _dim(spark, d)).components


@query("pca_feature_scores", "feature:s pca_score:d")
def pca_feature_scores(spark, d):
    return modelling.pca_report(table(spark, d, "embeddings"), "embedding", _dim(spark, d)).feature_scores


def _dim(spark, d) -> int:
    return table(spark, d, "embeddings").select(F.max(F.size("embedding"))).first()[0]


@query(
    "forecast_evaluation",
    "model:s tn:i fp:i fn:i tp:i precision:d recall:d f1:d f2:d roc_auc:d pr_auc:d",
)
def forecast_evaluation(spark, d):
    """Logistic forecast beside persistence on the same split."""
    data = model_data(spark, d)
    model = modelling.predict(modelling.fit_logistic(data), data.test, "label", ["row_id"])
    last = data.test.select(
        "row_id",
        F.col("label").alias("y_true"),
        (F.col("lag_1") >= F.col("roll_mean_8")).cast("int").alias("y_pred"),
        (F.col("lag_1") >= F.col("roll_mean_8")).cast("double").alias("y_proba"),
    )
    both = model.withColumn("model", F.lit("logistic")).unionByName(last.withColumn("model", F.lit("persistence")))
    return evaluation.compare_models(both, "y_true", "y_pred", "y_proba")
