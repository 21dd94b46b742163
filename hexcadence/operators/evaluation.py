"""Binary classification metrics on prediction tables, exact and tie-aware, for many models at once.

A prediction table has a label column (0/1), a score and/or a predicted label, and optionally
grouping columns such as the model name.  Everything is computed from counts: the confusion matrix
from one aggregate, threshold sweeps from counts per threshold bucket, areas from counts per
distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.functions.ranks import running_totals

# Reported thresholds.
REPORT_THRESHOLDS = (0.3, 0.5, 0.7, 0.9)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def precision_of(tp: Column, fp: Column) -> Column:
    return _zero(F.try_divide(tp.cast("double"), (tp + fp).cast("double")))


def recall_of(tp: Column, fn: Column) -> Column:
    return _zero(F.try_divide(tp.cast("double"), (tp + fn).cast("double")))


def fbeta_of(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    top = F.lit(1 + b) * tp
    return _zero(F.try_divide(top, top + F.lit(b) * fn + fp))


def score_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": precision_of(tp, fp),
        "recall": recall_of(tp, fn),
        "f1": fbeta_of(tp, fp, fn, 1),
        "f2": fbeta_of(tp, fp, fn, 2),
    }


def confusion(df: DataFrame, y: str, pred: str, groups: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(y).cast("boolean"), F.col(pred).cast("boolean")
    return df.groupBy(*groups).agg(
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(t & p).alias("tp"),
    )


def metrics(df: DataFrame, y: str, pred: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, F2 of the positive class; 0 where undefined."""
    c = confusion(df, y, pred, groups)
    return c.select(*groups, *[e.alias(n) for n, e in score_columns(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def class_report(df: DataFrame, y: str, pred: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows 0, 1, accuracy, macro avg, weighted avg with precision, recall, F1 and support."""
    c = confusion(df, y, pred, groups)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    one = [precision_of(tp, fp), recall_of(tp, fn), fbeta_of(tp, fp, fn, 1), tp + fn]
    zero = [precision_of(tn, fn), recall_of(tn, fp), fbeta_of(tn, fn, fp, 1), tn + fp]
    acc = F.try_divide((tp + tn).cast("double"), n.cast("double"))

    def mean(i: int) -> Column:
        return (zero[i] + one[i]) / F.lit(2.0)

    def weighted(i: int) -> Column:
        return F.try_divide(zero[i] * zero[3] + one[i] * one[3], n.cast("double"))

    rows = {
        "0": zero,
        "1": one,
        "accuracy": [acc, acc, acc, n],
        "macro avg": [mean(0), mean(1), mean(2), n],
        "weighted avg": [weighted(0), weighted(1), weighted(2), n],
    }
    names = ("precision", "recall", "f1_score", "support")
    items = F.array(
        *[
            F.named_struct(F.lit("label"), F.lit(k), *[x for nm, e in zip(names, v) for x in (F.lit(nm), e)])
            for k, v in rows.items()
        ]
    )
    return c.select(*groups, F.explode(items).alias("_r")).select(*groups, "_r.*")


def areas(df: DataFrame, y: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (null with one class) and average precision.

    Rows collapse to distinct scores first; cumulative sums run in score buckets.
    """
    groups = list(groups)
    hist = (
        df.where(F.col(score).isNotNull())
        .groupBy(*groups, score)
        .agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    cum = running_totals(hist, score, {"pos_above": "pos", "n_above": "n"}, groups, descending=True)
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    above = F.col("pos_above").cast("double")
    sums = cum.groupBy(*groups).agg(
        F.sum(pos).alias("p"),
        F.sum(n - pos).alias("q"),
        F.sum((n - pos) * (above + pos / 2)).alias("wins"),
        F.sum(pos * (above + pos) / (F.col("n_above") + n)).alias("ap"),
    )
    return sums.select(
        *groups,
        F.try_divide("wins", F.col("p") * F.col("q")).alias("roc_auc"),
        F.try_divide("ap", "p").alias("pr_auc"),
    )


def linear_thresholds(start: float, stop: float, num: int) -> list[float]:
    step = (stop - start) / (num - 1)
    return [start + i * step for i in range(num - 1)] + [stop]


def threshold_counts(
    df: DataFrame, y: str, score: str, thresholds: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """tp and fp at every threshold from one aggregate over the table.

    A row is counted once, in the bucket of the largest threshold it reaches; suffix sums over
    the buckets (at most one more than thresholds) give the rest.
    """
    groups = list(groups)
    ts = sorted(thresholds)
    bucket = _bucket_of(F.col(score), ts)
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(*groups, bucket.alias("_k"))
        .agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    slots = F.explode(
        F.array(*[F.named_struct(F.lit("_k"), F.lit(i), F.lit("threshold"), F.lit(t)) for i, t in enumerate([None, *ts])])
    )
    totals = counts.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("n").alias("n_test"))
    grid = totals.select(*groups, "n_pos", "n_test", slots.alias("_s")).select(
        *groups, "n_pos", "n_test", "_s._k", "_s.threshold"
    )
    full = grid.join(counts, [*groups, "_k"], "left")
    above = Window.partitionBy(*groups).orderBy(F.desc("_k"))
    out = full.withColumns(
        {
            "tp": F.sum(F.coalesce("pos", F.lit(0))).over(above),
            "flagged": F.sum(F.coalesce("n", F.lit(0))).over(above),
        }
    )
    return out.where(F.col("threshold").isNotNull()).select(
        *groups,
        "threshold",
        "n_test",
        "n_pos",
        "tp",
        (F.col("flagged") - F.col("tp")).alias("fp"),
        (F.col("n_pos") - F.col("tp")).alias("fn"),
    )


def _bucket_of(score: Column, ts: Sequence[float]) -> Column:
    """Number of thresholds that are <= score, by a balanced tree of comparisons; any spacing, repeats allowed."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(score >= F.lit(ts[middle - 1]), among(middle, high)).otherwise(among(low, middle - 1))

    return among(0, len(ts))


def threshold_sweep(
    df: DataFrame, y: str, score: str, thresholds: Sequence[float] | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1, F2 at each threshold (101 even ones by default)."""
    ts = linear_thresholds(0.0, 1.0, 101) if thresholds is None else thresholds
    c = threshold_counts(df, y, score, ts, groups)
    return c.select(
        *groups,
        "threshold",
        "n_test",
        "n_pos",
        F.try_divide(F.col("n_pos").cast("double"), F.col("n_test")).alias("pos_rate"),
        *[e.alias(n) for n, e in score_columns(F.col("tp"), F.col("fp"), F.col("fn")).items()],
    )


def best_threshold(sweep: DataFrame, metric: str = "f2", groups: Sequence[str] = ()) -> DataFrame:
    """Row with the largest metric, the lowest threshold on ties."""
    w = Window.partitionBy(*groups).orderBy(F.round(metric, 12).desc(), "threshold")
    return sweep.withColumn("_p", F.row_number().over(w)).where(F.col("_p") == 1).drop("_p")


def metric_sweep(
    df: DataFrame, y: str, score: str, metric: str = "f2", beta: float = 2.0, groups: Sequence[str] = ()
) -> DataFrame:
    """One metric at 100 even thresholds from 0.01 to 0.99: ``f2`` (with ``beta``), precision or recall."""
    c = threshold_counts(df, y, score, linear_thresholds(0.01, 0.99, 100), groups)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    value = {
        "f2": fbeta_of(tp, fp, fn, beta),
        "precision": precision_of(tp, fp),
        "recall": recall_of(tp, fn),
    }[metric]
    return c.select(*groups, "threshold", value.alias(f"{metric}_score"))


def errors(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.where(F.col(y) != F.col(pred))


def compare_models(df: DataFrame, y: str, pred: str, score: str, model: str = "model") -> DataFrame:
    """Confusion counts, metrics and areas of every model in one prediction table."""
    c = confusion(df, y, pred, [model])
    scored = c.withColumns(score_columns(F.col("tp"), F.col("fp"), F.col("fn")))
    return scored.join(areas(df, y, score, [model]), model)


# --- ensembles ----------------------------------------------------------------------------------


def hard_vote(df: DataFrame, keys: Sequence[str], pred: str) -> DataFrame:
    """Mean label per row key, rounded half to even."""
    return df.groupBy(*keys).agg(F.bround(F.avg(pred), 0).cast("int").alias("vote"))


def soft_vote(df: DataFrame, keys: Sequence[str], score: str, threshold: float) -> DataFrame:
    out = df.groupBy(*keys).agg(F.avg(score).alias("score"))
    return out.withColumn("vote", (F.col("score") >= threshold).cast("int"))


def weighted_vote(
    df: DataFrame, keys: Sequence[str], score: str, model: str, weights: dict[str, float], threshold: float
) -> DataFrame:
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(model)]
    out = df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(score) * w), F.sum(w)).alias("score"))
    return out.withColumn("vote", (F.col("score") >= threshold).cast("int"))
