"""Queries on the evaluation of predictions (a label and scores derived from the events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcadence.operators import evaluation as ev
from hexcadence.workload.base import query, table

# Two models score every event; scores have ties on purpose.
_PRED = """
  SELECT event_id, CAST(value > 50 AS INTEGER) AS y_true, m.model,
    CASE WHEN m.model = 'first' THEN event_id * 37 % 1000 / 1e3
         ELSE least(sqrt(abs(value)) / 15e0, 1e0) * 0.5e0 + event_id * 53 % 1000 / 2e3 END AS y_proba
  FROM events CROSS JOIN (SELECT unnest(['first', 'second']) AS model) m
"""
_LABELLED = f"SELECT *, CAST(y_proba >= 0.5 AS INTEGER) AS y_pred FROM ({_PRED}) AS p"


def predictions(spark, d):
    i = F.col("event_id")
    first = i * 37 % 1000 / F.lit(1e3)
    second = F.least(F.sqrt(F.abs("value")) / F.lit(15.0), F.lit(1.0)) * 0.5 + i * 53 % 1000 / F.lit(2e3)
    pairs = F.array(
        F.named_struct(F.lit("model"), F.lit("first"), F.lit("y_proba"), first),
        F.named_struct(F.lit("model"), F.lit("second"), F.lit("y_proba"), second),
    )
    e = table(spark, d, "events").select(
        "event_id", (F.col("value") > 50).cast("int").alias("y_true"), F.explode(pairs).alias("m")
    )
    return e.select("event_id", "y_true", "m.model", "m.y_proba").withColumn(
        "y_pred", (F.col("y_proba") >= 0.5).cast("int")
    )


_CM = """
  count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp
"""
_CM_SQL = f"SELECT model, {_CM} FROM ({_LABELLED}) AS l GROUP BY model"


@query("confusion_matrix", "model:s tn:i fp:i fn:i tp:i", _CM_SQL)
def confusion_matrix(spark, d):
    return ev.confusion(predictions(spark, d), "y_true", "y_pred", ["model"])


def _scores(tp="tp", fp="fp", fn="fn"):
    return f"""
      coalesce({tp} / NULLIF(CAST({tp} + {fp} AS DOUBLE), 0), 0) AS precision,
      coalesce({tp} / NULLIF(CAST({tp} + {fn} AS DOUBLE), 0), 0) AS recall,
      coalesce(2e0 * {tp} / NULLIF(2e0 * {tp} + {fn} + {fp}, 0), 0) AS f1,
      coalesce(5e0 * {tp} / NULLIF(5e0 * {tp} + 4e0 * {fn} + {fp}, 0), 0) AS f2
    """


@query(
    "binary_metrics", "model:s precision:d recall:d f1:d f2:d", f"SELECT model, {_scores()} FROM ({_CM_SQL}) AS c"
)
def binary_metrics(spark, d):
    return ev.metrics(predictions(spark, d), "y_true", "y_pred", ["model"])


@query(
    "class_report",
    "model:s label:s precision:d recall:d f1_score:d support:i",
    f"""
    WITH c AS ({_CM_SQL}),
    z AS (SELECT model, tn / CAST(tn + fn AS DOUBLE) AS p0, tn / CAST(tn + fp AS DOUBLE) AS r0, 2e0 * tn / (2 * tn + fp + fn) AS f0,
            tn + fp AS s0, tp / CAST(tp + fp AS DOUBLE) AS p1, tp / CAST(tp + fn AS DOUBLE) AS r1,
            2e0 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1, tn + fp + fn + tp AS n, (tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE) AS acc FROM c)
    SELECT model, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM z
    UNION ALL SELECT model, '1', p1, r1, f1, s1 FROM z
    UNION ALL SELECT model, 'accuracy', acc, acc, acc, n FROM z
    UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM z
    UNION ALL SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM z
    """,
)
def class_report(spark, d):
    return ev.class_report(predictions(spark, d), "y_true", "y_pred", ["model"])


_AREAS = f"""
  WITH l AS ({_LABELLED}),
  h AS (SELECT model, y_proba, sum(y_true) AS pos, count(*) AS n FROM l GROUP BY 1, 2),
  c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM h WINDOW w AS (PARTITION BY model ORDER BY y_proba DESC))
  SELECT model, sum((n - pos) * (cp - pos / 2e0)) / (sum(pos) * CAST(sum(n - pos) AS DOUBLE)) AS roc_auc,
    sum(pos * CAST(cp AS DOUBLE) / cn) / sum(pos) AS pr_auc FROM c GROUP BY model
"""


@query("roc_pr_areas", "model:s roc_auc:d pr_auc:d", _AREAS)
def roc_pr_areas(spark, d):
    return ev.areas(predictions(spark, d), "y_true", "y_proba", ["model"])


def _sweep_sql(thresholds: str) -> str:
    return f"""
    WITH t AS ({thresholds}), l AS ({_LABELLED}),
    c AS (SELECT l.model, t.threshold, count(*) AS n_test, sum(y_true) AS n_pos,
            count(*) FILTER (y_true = 1 AND y_proba >= threshold) AS tp,
            count(*) FILTER (y_true = 0 AND y_proba >= threshold) AS fp,
            count(*) FILTER (y_true = 1 AND NOT y_proba >= threshold) AS fn FROM l CROSS JOIN t GROUP BY ALL)
    SELECT model, threshold, n_test, n_pos, n_pos / CAST(n_test AS DOUBLE) AS pos_rate, {_scores()} FROM c
    """


_EVEN = "SELECT CASE WHEN k = 100 THEN 1e0 ELSE k * 1e-2 END AS threshold FROM range(0, 101) AS r(k)"
_SWEEP_COLS = "model:s threshold:d n_test:i n_pos:i pos_rate:d precision:d recall:d f1:d f2:d"


@query("threshold_sweep", _SWEEP_COLS, _sweep_sql(_EVEN))
def threshold_sweep(spark, d):
    return ev.threshold_sweep(predictions(spark, d), "y_true", "y_proba", groups=["model"])


@query("fixed_thresholds", _SWEEP_COLS, _sweep_sql("SELECT unnest([0.3e0, 0.5e0, 0.7e0, 0.9e0]) AS threshold"))
def fixed_thresholds(spark, d):
    return ev.threshold_sweep(predictions(spark, d), "y_true", "y_proba", ev.REPORT_THRESHOLDS, ["model"])


# Twenty uneven thresholds: k cubed over 8,000.
_UNEVEN = [k**3 / 8000 for k in range(1, 21)]


@query(
    "threshold_sweep_uneven",
    _SWEEP_COLS,
    _sweep_sql("SELECT k * k * k / 8000e0 AS threshold FROM range(1, 21) AS r(k)"),
)
def threshold_sweep_uneven(spark, d):
    return ev.threshold_sweep(predictions(spark, d), "y_true", "y_proba", _UNEVEN, ["model"])


@query(
    "best_threshold",
    "model:s threshold:d f2:d",
    f"""
    SELECT model, threshold, f2 FROM ({_sweep_sql(_EVEN)}) AS s
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(f2, 12) DESC, threshold) = 1
    """,
)
def best_threshold(spark, d):
    sweep = ev.threshold_sweep(predictions(spark, d), "y_true", "y_proba", groups=["model"])
    return ev.best_threshold(sweep, "f2", ["model"])


_STEP = (0.99 - 0.01) / 99
_FINE = f"SELECT CASE WHEN k = 99 THEN 0.99e0 ELSE 0.01e0 + k * {_STEP!r} END AS threshold FROM range(0, 100) AS r(k)"


@query(
    "metric_sweep",
    "model:s threshold:d f2_score:d precision_score:d recall_score:d",
    f"SELECT model, threshold, f2 AS f2_score, precision AS precision_score, recall AS recall_score FROM ({_sweep_sql(_FINE)}) AS s",
)
def metric_sweep(spark, d):
    p = predictions(spark, d)
    parts = [ev.metric_sweep(p, "y_true", "y_proba", m, groups=["model"]) for m in ("f2", "precision", "recall")]
    return parts[0].join(parts[1], ["model", "threshold"]).join(parts[2], ["model", "threshold"])


@query(
    "misclassified_rows",
    "event_id:i model:s y_true:i y_pred:i",
    f"SELECT event_id, model, y_true, y_pred FROM ({_LABELLED}) AS l WHERE y_true <> y_pred",
)
def misclassified_rows(spark, d):
    return ev.errors(predictions(spark, d), "y_true", "y_pred")


@query(
    "model_comparison",
    "model:s tn:i fp:i fn:i tp:i precision:d recall:d f1:d f2:d roc_auc:d pr_auc:d",
    f"SELECT c.*, a.roc_auc, a.pr_auc FROM (SELECT *, {_scores()} FROM ({_CM_SQL}) AS k) c JOIN ({_AREAS}) a USING (model)",
)
def model_comparison(spark, d):
    return ev.compare_models(predictions(spark, d), "y_true", "y_pred", "y_proba")


@query(
    "hard_vote",
    "event_id:i vote:i",
    f"SELECT event_id, CAST(round_even(avg(y_pred), 0) AS INTEGER) AS vote FROM ({_LABELLED}) AS l GROUP BY 1",
)
def hard_vote(spark, d):
    return ev.hard_vote(predictions(spark, d), ["event_id"], "y_pred")


@query(
    "soft_vote",
    "event_id:i score:d vote:i",
    f"SELECT event_id, avg(y_proba) AS score, CAST(avg(y_proba) >= 0.6 AS INTEGER) AS vote FROM ({_LABELLED}) AS l GROUP BY 1",
)
def soft_vote(spark, d):
    return ev.soft_vote(predictions(spark, d), ["event_id"], "y_proba", 0.6)


@query(
    "weighted_vote",
    "event_id:i score:d vote:i",
    f"""
    SELECT event_id, s AS score, CAST(s >= 0.5 AS INTEGER) AS vote FROM (
      SELECT event_id, sum(y_proba * CASE model WHEN 'first' THEN 1e0 ELSE 3e0 END) / 4e0 AS s FROM ({_LABELLED}) AS l GROUP BY 1) AS v
    """,
)
def weighted_vote(spark, d):
    return ev.weighted_vote(
        predictions(spark, d), ["event_id"], "y_proba", "model", {"first": 1.0, "second": 3.0}, 0.5
    )
