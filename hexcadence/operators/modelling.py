"""Preparation, MLlib models, and tables about fitted models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcadence.functions.permute import permuted
from hexcadence.functions.ranks import dense_index
from hexcadence.operators import clean, evaluation, splits
from hexcadence.operators.windows import average_rank
from hexcadence.session import materialise, scratch_path

# Default model parameters and the cap of the class weight.
LOGISTIC = {"C": 0.1, "l1_ratio": 1.0, "max_iter": 1000}
BOOSTED = {
    "regularised": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8},
    "leafwise": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 1.0},
    "symmetric": {"maxIter": 1000, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 1.0},
}
WEIGHT_CAP = 10.0
SEED = 42


# --- preparation --------------------------------------------------------------------------------


def scaler_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation of each column."""
    return train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )


def standardise(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled by fitted statistics; a constant column is only centred."""
    return df.withColumns(
        {
            c: (F.col(c) - stats.select(f"mean_{c}").scalar())
            / stats.select(F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0)).scalar()
            for c in columns
        }
    )


def class_weights(df: DataFrame, label: str, mode: str = "balanced", cap: float = WEIGHT_CAP) -> DataFrame:
    """Weight per class: ``balanced`` n / (2 n_c), or ``ratio`` neg / pos (capped) for positives."""
    counts = df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))
    neg = F.col("n") - F.col("pos")
    if mode == "balanced":
        rows = [(0, F.try_divide(F.col("n"), 2 * neg)), (1, F.try_divide(F.col("n"), 2 * F.col("pos")))]
    else:
        rows = [(0, F.lit(1.0)), (1, F.least(neg / F.greatest(F.col("pos"), F.lit(1.0)), F.lit(cap)))]
    items = F.array(*[F.named_struct(F.lit(label), F.lit(k), F.lit("weight"), w) for k, w in rows])
    return counts.select(F.inline(items))


def with_weights(df: DataFrame, weights: DataFrame, label: str, out: str = "weight") -> DataFrame:
    picked = {k: weights.where(F.col(label) == k).select("weight").scalar() for k in (0, 1)}
    return df.withColumn(out, F.when(F.col(label) == 1, picked[1]).otherwise(picked[0]))


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]
    label: str
    validation: DataFrame | None = None


def prepare(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    bin_col: str,
    *,
    clip: dict[str, float] | None = None,
    numeric: Sequence[str] | None = None,
    train_size: float = splits.TRAIN_SIZE,
    keys: Sequence[str] = (),
    validation: bool = False,
) -> Prepared:
    """Clip, split by time, standardise on the training part only, add balanced weights.

    With ``validation`` the rows after the training part are halved into validation and test.  Training rows are
    checkpointed, because training passes over them many times.
    """
    numeric = list(features if numeric is None else numeric)
    df = clean.clip_upper(df, clip or {})
    kept = df.select(*keys, bin_col, label, *features)
    parts = materialise(splits.temporal_split(kept, bin_col, train_size, validation))
    train, test, held = (parts.where(F.col("split") == p).drop("split") for p in ("train", "test", "val"))
    stats = scaler_stats(train, numeric)
    weights = class_weights(train, label)
    ready = materialise(with_weights(standardise(train, stats, numeric), weights, label))
    scaled = [standardise(part, stats, numeric) for part in (test, held)]
    return Prepared(ready, scaled[0], list(features), label, scaled[1] if validation else None)


# --- models -------------------------------------------------------------------------------------


def logistic(label: str, total_weight: float, C: float = 0.1, l1_ratio: float = 1.0, max_iter: int = 1000) -> LogisticRegression:
    """Logistic regression with the penalty strength of ``C`` on a summed loss."""
    return LogisticRegression(
        labelCol=label,
        weightCol="weight",
        elasticNetParam=l1_ratio,
        regParam=1.0 / (C * total_weight),
        maxIter=max_iter,
        standardization=False,
    )


def boosted(label: str, preset: str = "regularised", **overrides) -> GBTClassifier:
    params = {**BOOSTED[preset], **overrides}
    return GBTClassifier(labelCol=label, weightCol="weight", seed=SEED, **params)


def fit(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return without_summary(Pipeline(stages=[assembler, estimator]).fit(train), train.sparkSession)


def without_summary(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model as it is read back from a file: its stages have no training summary.

    A binary summary holds the session, and a task that predicts takes the whole model along.  Once anything in that session
    has been observed (``DataFrame.observe``) the session can no longer be serialised, and every prediction would fail.
    """

    def read_back(stage):
        path = scratch_path(spark, "model")
        stage.write().save(path)
        return type(stage).load(path)

    return PipelineModel(stages=[read_back(s) if getattr(s, "hasSummary", False) else s for s in model.stages])


def predict(model: PipelineModel, df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Prediction table: keys, y_true, y_pred, y_proba."""
    out = model.transform(df)
    return out.select(
        *keys,
        F.col(label).cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability")[1].alias("y_proba"),
    )


def fit_logistic(data: Prepared, **params) -> PipelineModel:
    total = data.train.agg(F.sum("weight")).first()[0]
    return fit(data.train, data.features, logistic(data.label, total, **params))


def stack_models(fit_on: DataFrame, apply_to: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Logistic regression on the probabilities of several models; ``y_stacked`` for the rows of ``apply_to``.

    ``fit_on`` holds predictions for rows that no model was trained on and that are not to be judged.
    """

    def one_row(predictions: DataFrame) -> DataFrame:
        return predictions.groupBy(*keys, "y_true").pivot("model", list(models)).agg(F.max("y_proba"))

    wide = materialise(one_row(fit_on))
    assembler = VectorAssembler(inputCols=list(models), outputCol="features")
    # The usual unit penalty on a summed loss.
    reg = 1.0 / max(wide.count(), 1)
    final = LogisticRegression(labelCol="y_true", regParam=reg, standardization=False)
    stacker = without_summary(Pipeline(stages=[assembler, final]).fit(wide), wide.sparkSession)
    out = stacker.transform(one_row(apply_to))
    return out.select(*keys, "y_true", F.col("prediction").cast("int").alias("y_stacked"))


# --- tables about models ------------------------------------------------------------------------


def coefficient_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Coefficient, direction, odds ratio and importance per feature (one row per feature)."""
    coefs = [(f, float(c)) for f, c in zip(features, model.stages[-1].coefficients)]
    df = spark.createDataFrame(coefs, "feature string, coef double")
    return df.withColumns(
        {
            "effect": F.when(F.col("coef") > 0, "increase").otherwise("decrease"),
            "odds_ratio": F.exp("coef"),
            "importance": F.abs("coef"),
        }
    ).orderBy(F.desc("coef"), "feature")


def importance_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Tree importance with average ranks."""
    values = model.stages[-1].featureImportances.toArray()
    df = spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    )
    return average_rank(df, "importance").orderBy(F.desc("importance"), "feature")


def permuted_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], repeats: int, seed: int = SEED) -> DataFrame:
    """Every row with the ``columns`` of the row that each repeat's permutation sends to its place.

    Rows are numbered once in the order of ``keys`` (which must be unique); value i of repeat r moves to the place that a
    keyed formula gives, so all repeats share that numbering and one shuffle by place. Adds ``moved``, an array of
    (repeat, number, values): ``number`` is the source row's, ``values`` a struct of its columns.
    """
    kept = [c for c in df.columns]
    numbered = materialise(dense_index(df, list(keys), "_i"))
    n = numbered.count()
    values = F.struct(*[F.col(c) for c in columns])
    own = F.struct(F.lit(-1).alias("repeat"), F.col("_i").alias("at"))
    sent = [F.struct(F.lit(r).alias("repeat"), permuted(F.col("_i"), n, seed + r).alias("at")) for r in range(repeats)]
    copies = numbered.select("_i", F.struct(*kept).alias("_row"), values.alias("_values"), F.explode(F.array(own, *sent)).alias("_to")).select(
        F.col("_to.at").alias("_at"), F.when(F.col("_to.repeat") < 0, F.col("_row")).alias("_row"),
        F.when(F.col("_to.repeat") >= 0, F.struct(F.col("_to.repeat").alias("repeat"), F.col("_i").alias("number"), F.col("_values").alias("values"))).alias("_moved"),
    )
    # A place has one row and one entry for each repeat.
    placed = copies.groupBy("_at").agg(F.max("_row").alias("_row"), F.collect_list("_moved").alias("moved"))
    return placed.select("_row.*", F.array_sort("moved").alias("moved"))


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    repeats: int = 5,
    seed: int = SEED,
) -> DataFrame:
    """Loss of accuracy when one feature is permuted, mean and deviation over the repeats.

    The permutations are exact and by formula (``permuted_rows``); all features of all repeats are scored in one pass.
    """
    features = list(features)
    right = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    base_score = predict(model, df, label).agg(right.alias("s")).select("s").scalar()
    assembler_free = PipelineModel(stages=model.stages[1:])
    rows = permuted_rows(df.select(*keys, label, *features), keys, features, repeats, seed).withColumn("_m", F.explode("moved"))

    def exchanged(feature: str):
        x = F.array(*[(F.col("_m")["values"][g] if g == feature else F.col(g)).cast("double") for g in features])
        return F.struct(F.lit(feature).alias("feature"), x.alias("x"))

    long = rows.select(label, F.col("_m.repeat").alias("repeat"), F.explode(F.array(*map(exchanged, features))).alias("_v"))
    scored = assembler_free.transform(long.select(label, "repeat", "_v.feature", array_to_vector("_v.x").alias("features")))
    hit = scored.groupBy("feature", "repeat").agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("score"))
    drop = base_score - F.col("score")
    return (
        hit.withColumn("drop", drop)
        .groupBy("feature")
        .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


@dataclass
class PcaReport:
    components: DataFrame
    loadings: DataFrame
    feature_scores: DataFrame


def pca_report(df: DataFrame, vector: str, n_features: int, keep: float = 0.95) -> PcaReport:
    """Explained variance, loadings and feature scores (|loading| x variance share).

    ``vector`` is an array column; it is standardised first.  Outputs have one row per component or
    feature.
    """
    spark = df.sparkSession
    vectors = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("x"))
    fitted = Pipeline(
        stages=[
            StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
            PCA(k=n_features, inputCol="z", outputCol="p"),
        ]
    ).fit(vectors).stages[-1]
    share = [float(s) for s in fitted.explainedVariance]
    total, rows, needed = 0.0, [], n_features
    for i, s in enumerate(share):
        total += s
        rows.append((i + 1, s, total))
        if total > keep:
            needed = min(needed, i + 1)
    matrix = fitted.pc.toArray()
    loadings = [
        (f"x{f}", c + 1, float(matrix[f][c])) for f in range(n_features) for c in range(needed)
    ]
    scores = [
        (f"x{f}", sum(abs(float(matrix[f][c])) * share[c] for c in range(needed))) for f in range(n_features)
    ]
    return PcaReport(
        spark.createDataFrame(rows, "component int, variance_ratio double, cumulative double"),
        spark.createDataFrame(loadings, "feature string, component int, loading double"),
        spark.createDataFrame(scores, "feature string, pca_score double").orderBy(F.desc("pca_score")),
    )


def components_needed(components: DataFrame, shares: Sequence[float] = (0.8, 0.9, 0.95)) -> DataFrame:
    """First component at which the cumulative variance passes each share."""
    return components.agg(
        *[
            F.min(F.when(F.col("cumulative") > s, F.col("component"))).alias(f"n_{round(s * 100)}")
            for s in shares
        ]
    )


def refit_top(
    data: Prepared, configs: Sequence[dict], key: str, share: float = 0.2
) -> DataFrame:
    """For each parameter row: threshold from an inner hold-out, refit on all, metrics on the test part.

    ``configs`` is a short ranked list (a parameter grid), so models are fitted one after another.
    """
    out = None
    inner = materialise(splits.stratified_holdout(data.train, key, data.label, share))
    fit_part, val_part = inner.where(~F.col("is_holdout")), inner.where(F.col("is_holdout"))
    total = fit_part.agg(F.sum("weight")).first()[0]
    for rank, cfg in enumerate(configs, 1):
        probe = fit(fit_part, data.features, logistic(data.label, total, **cfg))
        val = predict(probe, val_part, data.label)
        sweep = evaluation.threshold_sweep(val, "y_true", "y_proba")
        best = evaluation.best_threshold(sweep, "f2").first()["threshold"]
        final = predict(fit_logistic(data, **cfg), data.test, data.label)
        final = final.withColumn("y_pred", (F.col("y_proba") >= best).cast("int"))
        row = evaluation.compare_models(final.withColumn("model", F.lit(f"rank_{rank}")), "y_true", "y_pred", "y_proba")
        row = row.withColumns({"best_t": F.lit(best), "C": F.lit(cfg.get("C", LOGISTIC["C"]))})
        out = row if out is None else out.unionByName(row)
    return out
