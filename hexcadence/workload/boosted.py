"""Boosted trees of the forecast, grown again in SQL: one chain of statements for every level or leaf."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hexcadence.operators import boosting, splits, tuning
from hexcadence.operators.boosting import BINS, PRESETS, SEED, UNIT, Preset
from hexcadence.operators.tuning import rungs
from hexcadence.plans import forecast
from hexcadence.session import scratch_path
from hexcadence.sources import runs
from hexcadence.workload.base import PLACED_ORDERS, placed_orders, query, sql_bin
from hexcadence.workload.cleaning import hash_sql
from hexcadence.workload.time_cube import _dense_sql, features_sql

#: Whole numbers, so that both engines bin them alike.
FEATURES = ["lag_1", "lag_2", "lag_4", "lag_8", "roll_sum_4", "roll_sum_8", "zero_streak_prev", "month"]
ROUNDS = 2  #: of the query: a round costs about ten passes, and its SQL one statement chain a split

_COUNTS = f"SELECT c_nationkey, {sql_bin('o_orderdate', 'weekly')} AS time_bin, count(*) AS n FROM ({PLACED_ORDERS}) AS p GROUP BY 1, 2"


def boosting_rows(spark, d):
    """Weekly orders per nation: whole-number features, whether a week is at least as busy as the eight before, split."""
    table = forecast.feature_table(placed_orders(spark, d), "c_nationkey", "o_orderdate", "weekly", target="n")
    labelled = table.withColumns({"month": F.month("time_bin"), "label": (F.col("n") * 8 >= F.col("roll_sum_8")).cast("int")})
    return splits.temporal_split(labelled, "time_bin").select("c_nationkey", "time_bin", "label", "split", *FEATURES)


ROWS_SQL = f"""
  features AS MATERIALIZED (
    SELECT c_nationkey, time_bin, CAST(n * 8 >= roll_sum_8 AS INTEGER) AS label, month(time_bin) AS month,
      {', '.join(f for f in FEATURES if f != 'month')}
    FROM ({features_sql(_dense_sql(_COUNTS, 'c_nationkey', 2), 'c_nationkey')}) AS f),
  placed AS (
    SELECT time_bin, coalesce(sum(k) OVER (ORDER BY time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(k) OVER () AS total
    FROM (SELECT time_bin, count(*) AS k FROM features GROUP BY 1) AS b),
  split_rows AS MATERIALIZED (
    SELECT features.*, CASE WHEN pos < floor(total * 0.7e0) THEN 'train' ELSE 'test' END AS split FROM features JOIN placed USING (time_bin))
"""


def _tree_sql(tag: str, model: str, p: Preset, t: int) -> tuple[list[str], str]:
    """Statements that grow tree ``t`` on the fitted rows of ``tag``_rows, its table of nodes, and scores of all rows."""
    name, numbered = f"{tag}_{model}_{t}", f"{tag}_rows"
    usable = boosting.tree_features(len(FEATURES), p.columns, t)
    l2, unit = p.l2 * UNIT, float(UNIT)
    score = lambda g, h: f"CASE WHEN {h} + {l2!r} > 0 THEN CAST({g} AS DOUBLE) * {g} / ({h} + {l2!r}) ELSE 0 END"
    drawn = "true" if p.rows >= 1 else f"{hash_sql('c_nationkey', 'time_bin', seed=SEED + t)} / {float(1 << 60)!r} < {p.rows!r}"
    before = f"{tag}_{model}_{t - 1}_scored" if t else f"(SELECT id, 0e0 AS score FROM {numbered})"
    out = [
        f"{name}_gh AS MATERIALIZED (SELECT id, bins, floor((c - label) * {unit!r} + 0.5)::BIGINT AS g, floor(c * (1 - c) * {unit!r} + 0.5)::BIGINT AS h, "
        f"fitted AND {drawn} AS seen FROM (SELECT *, 1 / (1 + exp(-score)) AS c FROM {numbered} JOIN {before} AS s USING (id)) AS x)",
        f"{name}_at0 AS MATERIALIZED (SELECT id, 1::BIGINT AS node FROM {name}_gh)",
    ]
    steps = p.leaves - 1 if p.growth == "leaf" else p.depth
    for k in range(steps):
        level = "true" if p.growth == "leaf" else f"node >= {1 << k}"
        out.append(
            f"{name}_hist{k} AS MATERIALIZED (SELECT node, f, bin, count(*) AS n, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM ("
            f"SELECT node, g, h, unnest({[f + 1 for f in usable]}) AS f1, f1 - 1 AS f, bins[f1] AS bin FROM {name}_gh JOIN {name}_at{k} USING (id) WHERE seen AND {level}) AS x GROUP BY 1, 2, 3)"
        )
        if p.growth == "symmetric":
            out.append(
                f"{name}_best{k} AS MATERIALIZED (WITH whole AS (SELECT node, sum(n)::BIGINT AS n, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM {name}_hist{k} WHERE f = {usable[0]} GROUP BY 1), "
                f"cuts AS (SELECT f, bin AS cut FROM (SELECT DISTINCT f, bin, max(bin) OVER (PARTITION BY f) AS last FROM {name}_hist{k}) AS x WHERE bin < last), "
                f"lefts AS (SELECT w.node, c.f, c.cut, w.n, w.g, w.h, coalesce(sum(x.g), 0)::BIGINT AS lg, coalesce(sum(x.h), 0)::BIGINT AS lh FROM whole w CROSS JOIN cuts c "
                f"LEFT JOIN {name}_hist{k} x ON x.node = w.node AND x.f = c.f AND x.bin <= c.cut GROUP BY 1, 2, 3, 4, 5, 6), "
                f"sums AS (SELECT f, cut, floor((sum({score('lg', 'lh')} + {score('(g - lg)', '(h - lh)')}) - sum({score('g', 'h')})) * 1000 + 0.5) AS gain FROM lefts GROUP BY 1, 2), "
                f"top AS (SELECT * FROM sums WHERE gain > 0 ORDER BY gain DESC, f, cut LIMIT 1) "
                f"SELECT node, f, cut, gain / 1000 / {unit!r} AS gain, n FROM whole CROSS JOIN top)"
            )
        else:
            pick = "LIMIT 1" if p.growth == "leaf" else ""
            out.append(
                f"{name}_best{k} AS MATERIALIZED (SELECT node, f, cut, gain / {unit!r} AS gain, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) AS place FROM ("
                f"SELECT *, {score('lg', 'lh')} + {score('(g - lg)', '(h - lh)')} - {score('g', 'h')} AS gain FROM ("
                f"SELECT node, f, bin AS cut, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(h) OVER w AS lh, "
                f"sum(n) OVER a AS n, sum(g) OVER a AS g, sum(h) OVER a AS h FROM {name}_hist{k} "
                f"WINDOW w AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, f)) AS x "
                f"WHERE ln < n AND least(ln, n - ln) >= {p.min_rows} AND least(lh, h - lh) >= {p.min_weight * UNIT!r}) AS y WHERE gain > 0) AS z "
                f"WHERE place = 1 ORDER BY gain DESC, node {pick})"
            )
        out.append(
            f"{name}_at{k + 1} AS MATERIALIZED (SELECT id, CASE WHEN b.f IS NULL THEN a.node WHEN r.bins[b.f + 1] <= b.cut THEN 2 * a.node ELSE 2 * a.node + 1 END AS node "
            f"FROM {name}_at{k} a JOIN {numbered} r USING (id) LEFT JOIN {name}_best{k} b ON a.node = b.node)"
        )
    leaf = f"CASE WHEN sum(h) FILTER (seen) + {l2!r} > 0 THEN {-p.learning_rate!r} * (sum(g) FILTER (seen))::BIGINT / ((sum(h) FILTER (seen))::BIGINT + {l2!r}) ELSE 0 END"
    out.append(
        f"{name}_leaves AS MATERIALIZED (SELECT node, count(*) FILTER (seen) AS n, coalesce({leaf}, 0) AS value FROM {name}_gh JOIN {name}_at{steps} USING (id) GROUP BY 1)"
    )
    out.append(
        f"{name}_scored AS MATERIALIZED (SELECT id, s.score + l.value AS score FROM {before} AS s JOIN {name}_at{steps} USING (id) JOIN {name}_leaves l USING (node))"
    )
    inner = " UNION ALL ".join(f"SELECT * FROM {name}_best{k}" for k in range(steps))
    rows = (
        f"SELECT '{model}' AS model, {t} AS tree, node, {FEATURES}[f + 1] AS feature, cut, gain, NULL AS value, n FROM ({inner}) AS i "
        f"UNION ALL SELECT '{model}', {t}, node, NULL, NULL, NULL, value, n FROM {name}_leaves WHERE n > 0"
    )
    return out, rows


def fit_sql(tag: str, presets: dict[str, Preset], rounds: int, rows: str, fitted: str) -> tuple[list[str], list[str]]:
    """Statements that bin and fit the rows of a query for which ``fitted`` holds, and each tree's table of nodes.

    ``{tag}_{model}_{rounds - 1}_scored`` then has the scores of all rows, by the id of ``{tag}_rows``.
    """
    items = ", ".join(f"quantile_cont(CAST({f} AS DOUBLE), {[i / BINS for i in range(1, BINS)]}) AS q_{f}" for f in FEATURES)
    bins = ", ".join(f"1 + len(list_filter(q_{f}, lambda c: {f} > c))" for f in FEATURES)
    statements = [
        f"{tag}_cuts AS MATERIALIZED (SELECT {items} FROM ({rows}) AS r WHERE {fitted})",
        f"{tag}_rows AS MATERIALIZED (SELECT row_number() OVER () AS id, r.* EXCLUDE ({', '.join(FEATURES)}), {fitted} AS fitted, [{bins}] AS bins "
        f"FROM ({rows}) AS r CROSS JOIN {tag}_cuts)",
    ]
    nodes = []
    for model, p in presets.items():
        for t in range(rounds):
            grown, table = _tree_sql(tag, model, p, t)
            statements += grown
            nodes.append(table)
    return statements, nodes


def trees_sql(presets: dict[str, Preset], rounds: int) -> str:
    statements, nodes = fit_sql("all", presets, rounds, "SELECT * FROM split_rows WHERE split = 'train'", "true")
    return f"WITH {ROWS_SQL}, {', '.join(statements)} " + " UNION ALL ".join(nodes)


@query(
    "boosted_variants",
    "model:s tree:i node:i feature:s cut:i gain:d2 value:d n:i",
    trees_sql(PRESETS, ROUNDS),
)
def boosted_variants(spark, d):
    """Every node of the three presets' first trees; nodes without rows are left out."""
    train = boosting_rows(spark, d).where("split = 'train'")
    data = boosting.binned(train, boosting.bin_cuts(train, FEATURES))
    models = boosting.fit(data, ["c_nationkey", "time_bin"], "label", PRESETS, FEATURES, rounds=ROUNDS)
    return boosting.tree_table(models, spark).where("n > 0")


# --- out-of-fold predictions ------------------------------------------------------------------------

N_FOLDS = 3
BASE_MODELS = {m: replace(PRESETS[m], depth=3, learning_rate=0.3) for m in ("regularised", "symmetric")}


def cross_fit_sql() -> str:
    statements, parts = [], []
    folded = f"SELECT *, {hash_sql('c_nationkey', 'time_bin')} % {N_FOLDS} AS fold FROM split_rows WHERE split = 'train'"
    for fold in range(N_FOLDS):
        tag = f"fold{fold}"
        grown, _ = fit_sql(tag, BASE_MODELS, ROUNDS, folded, f"fold != {fold}")
        statements += grown
        for model in BASE_MODELS:
            parts.append(
                f"SELECT c_nationkey, time_bin, fold, label, '{model}' AS model, 1 / (1 + exp(-score)) AS y_proba, "
                f"(SELECT count(*) FROM {tag}_rows WHERE fitted) AS n_fitted, (SELECT count(*) FROM {tag}_rows WHERE fitted AND fold = {fold}) AS n_own_fold "
                f"FROM {tag}_rows JOIN {tag}_{model}_{ROUNDS - 1}_scored USING (id) WHERE fold = {fold}"
            )
    return f"WITH {ROWS_SQL}, {', '.join(statements)} " + " UNION ALL ".join(parts)


def out_of_fold(spark, d):
    train = boosting_rows(spark, d).where("split = 'train'")
    folded = train.withColumn("fold", tuning.row_folds(["c_nationkey", "time_bin"], N_FOLDS))
    return tuning.cross_fit(folded, ["c_nationkey", "time_bin"], "label", FEATURES, "fold", N_FOLDS, BASE_MODELS, rounds=ROUNDS)


@query(
    "cross_fitted_models",
    "c_nationkey:i time_bin:t fold:i label:i model:s y_proba:d n_fitted:i n_own_fold:i",
    cross_fit_sql(),
)
def cross_fitted_models(spark, d):
    """Training rows, each predicted by models that were fitted without its fold."""
    return out_of_fold(spark, d)


# --- hyper-parameters ---------------------------------------------------------------------------------

CONFIGS = {
    f"depth{depth}_l2_{l2:g}": replace(PRESETS["regularised"], depth=depth, l2=l2, learning_rate=0.3, rows=1.0)
    for depth in (1, 2, 3)
    for l2 in (1.0, 50.0)
}
SPLITS, GAP = 3, 2


def halving_sql() -> str:
    statements, metrics = [], []
    statements.append(
        "roles AS (SELECT time_bin, i, n - (4 - fold) * (n // 4) AS s, n // 4 AS z, fold FROM (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS i, count(*) OVER () AS n "
        "FROM (SELECT DISTINCT time_bin FROM split_rows WHERE split = 'train') AS b) AS c CROSS JOIN (SELECT unnest(range(1, 4)) AS fold) AS f)"
    )
    for fold in range(1, SPLITS + 1):
        rows = (
            f"SELECT t.*, CASE WHEN i < s - {GAP} THEN 'train' ELSE 'test' END AS role FROM split_rows t JOIN roles r USING (time_bin) "
            f"WHERE split = 'train' AND r.fold = {fold} AND (i < s - {GAP} OR (i >= s AND i < s + z))"
        )
        grown, _ = fit_sql(f"k{fold}", CONFIGS, ROUNDS, rows, "role = 'train'")
        statements += grown
        for place, config in enumerate(CONFIGS):
            metrics.append(
                f"SELECT {fold} AS fold, '{config}' AS config, {place} AS place, count(*) FILTER (label = 1 AND score >= 0) AS tp, count(*) FILTER (label = 0 AND score >= 0) AS fp, "
                f"count(*) FILTER (label = 1 AND score < 0) AS fn, count(*) FILTER (label = 0 AND score < 0) AS tn "
                f"FROM k{fold}_rows JOIN k{fold}_{config.replace('.', '_')}_{ROUNDS - 1}_scored USING (id) WHERE NOT fitted"
            )
    statements.append(
        "measured AS MATERIALIZED (SELECT *, coalesce(5 * tp / nullif(CAST(5 * tp + 4 * fn + fp AS DOUBLE), 0), 0) AS f2 FROM (" + " UNION ALL ".join(metrics) + ") AS m)"
    )
    alive, results = "(SELECT config FROM measured)", []
    for r, (folds, n_configs, keep) in enumerate(rungs(len(CONFIGS), SPLITS)):
        statements.append(
            f"rung{r} AS MATERIALIZED (SELECT config, place, mean_f2, row_number() OVER (ORDER BY floor(mean_f2 * 1e9 + 0.5) DESC, place) AS rank, "
            f"row_number() OVER (ORDER BY floor(mean_f2 * 1e9 + 0.5) DESC, place) <= {keep} AS kept FROM ("
            f"SELECT config, place, avg(f2) AS mean_f2 FROM measured WHERE fold <= {max(folds)} AND config IN {alive} GROUP BY 1, 2) AS x)"
        )
        results.append(
            f"SELECT {r} AS rung, m.fold, m.config, tp, fp, fn, tn, f2, mean_f2, rank, kept FROM measured m JOIN rung{r} USING (config) WHERE m.fold IN ({', '.join(map(str, folds))})"
        )
        alive = f"(SELECT config FROM rung{r} WHERE kept)"
    return f"WITH {ROWS_SQL}, {', '.join(statements)} " + " UNION ALL ".join(results)


@query(
    "halving_ranks",
    "rung:i fold:i config:s tp:i fp:i fn:i tn:i f2:d mean_f2:d rank:i kept:b",
    halving_sql(),
)
def halving_ranks(spark, d):
    """Parameter sets ranked by successive halving over expanding folds, losers included."""
    train = boosting_rows(spark, d).where("split = 'train'")
    return tuning.halving(train, "time_bin", ["c_nationkey", "time_bin"], "label", FEATURES, CONFIGS, SPLITS, gap=GAP, rounds=ROUNDS)


# --- run sink -----------------------------------------------------------------------------------------

_PERSISTENCE_SQL = f"""
  WITH {ROWS_SQL}
  SELECT c_nationkey, time_bin, label AS y_true, CAST(lag_1 * 8 >= roll_sum_8 AS INTEGER) AS y_pred, CAST(lag_1 * 8 >= roll_sum_8 AS DOUBLE) AS y_proba, split FROM split_rows
"""


def _saved(spark, d) -> str:
    """Persistence as a run of test and training predictions: one attempt dies before its commit, the run is repeated twice."""
    last = (F.col("lag_1") * 8 >= F.col("roll_sum_8")).cast("int")
    rows = boosting_rows(spark, d).select(
        "c_nationkey", "time_bin", F.col("label").alias("y_true"), last.alias("y_pred"), last.cast("double").alias("y_proba"), "split"
    )
    right = rows.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]
    root = scratch_path(spark, "runs")
    rows.where("split = 'test'").write.parquet(f"{root}/attempts/persistence-killed")
    for _ in range(2):
        runs.save_run(rows, root, "persistence", model="persistence", params={"lag": 1}, metrics={"accuracy": right}, features=["lag_1", "roll_sum_8"])
    return root


@query("saved_predictions", "run:s c_nationkey:i time_bin:t y_true:i y_pred:i y_proba:d split:s", f"SELECT 'persistence' AS run, * FROM ({_PERSISTENCE_SQL}) AS p")
def saved_predictions(spark, d):
    return runs.read_runs(spark, _saved(spark, d))


@query(
    "saved_run_facts",
    "run:s model:s n_rows:i lag:s accuracy:d n_features:i",
    f"""
    SELECT 'persistence' AS run, 'persistence' AS model, count(*) AS n_rows, '1' AS lag, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy, 2 AS n_features
    FROM ({_PERSISTENCE_SQL}) AS p
    """,
)
def saved_run_facts(spark, d):
    found = runs.runs(spark, _saved(spark, d))
    return found.select("run", "model", "n_rows", F.col("params")["lag"].alias("lag"), F.col("metrics")["accuracy"].alias("accuracy"), F.size("features").alias("n_features"))
