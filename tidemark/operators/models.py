"""Baselines, preprocessing and estimators on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .boosting import LEAF_GRID, Model, Params, fit_leafwise, search_draws
from .labels import quantile as pooled_quantile
from .metrics import confusion_metrics, ranking_metrics, select_threshold
from .neighbours import neighbour_information
from .ranking import abs_spearman, importance_ensemble, quantile_mutual_information, stacked
from .ranks import column_quantiles

C_GRID = (0.01, 0.1, 1.0, 3.0)
TRIALS = 20


# ---- baselines


def climatology(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Every row of val and test forecast with the training event rate: ``y_true``, ``y_prob``, ``y_pred`` and the threshold
    chosen by F2 on val. The rate and the threshold are one row each, so both joins broadcast one row."""
    rate = df.where(F.col(split) == "train").agg(F.avg(label).alias("y_prob"))
    rows = df.where(F.col(split).isin("val", "test")).withColumn("y_true", F.col(label).cast("int")).crossJoin(F.broadcast(rate))
    best = select_threshold(rows.where(F.col(split) == "val").where("y_prob is not null")).select("threshold")
    return rows.crossJoin(F.broadcast(best)).withColumn("y_pred", (F.col("y_prob") >= F.col("threshold")).cast("int"))


def persistence(df: DataFrame, label: str, north: str, east: str, quantile: float, split: str = "split") -> DataFrame:
    """What is now stays: 1 where the horizontal magnitude (nulls as 0) reaches its pooled training quantile; all splits."""
    proxy = F.sqrt(F.pow(F.coalesce(F.col(north), F.lit(0.0)), F.lit(2.0)) + F.pow(F.coalesce(F.col(east), F.lit(0.0)), F.lit(2.0)))
    rows = df.withColumn("proxy", proxy)
    limit = pooled_quantile(rows.where(F.col(split) == "train"), "proxy", quantile, "limit")
    hit = (F.col("proxy") >= F.col("limit")).cast("int")
    return rows.crossJoin(F.broadcast(limit)).withColumns({"y_true": F.col(label).cast("int"), "y_prob": hit.cast("double"), "y_pred": hit})


# ---- preprocessing, learnt on the training split


def impute_and_scale(df: DataFrame, features: Sequence[str], split: str = "split", scale: bool = True, eps: float = 0.0) -> DataFrame:
    """Nulls to the training median (0 if a column has none), then (x - mean) / population deviation of the imputed training
    rows plus ``eps``; a constant column becomes 0. A few passes of one row each, whatever the number of columns."""
    train = df.where(F.col(split) == "train")
    m = {c: v[0] for c, v in column_quantiles(train, features, [0.5]).items()}
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m[c] if m[c] is not None else 0.0))) for c in features})
    if not scale:
        return filled
    s = filled.where(F.col(split) == "train").agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scaled = {}
    for c in features:
        mean, dev = s[f"m_{c}"] or 0.0, (s[f"s_{c}"] or 0.0) + eps
        scaled[c] = (F.col(c) - mean) / dev if dev else F.lit(0.0)
    return filled.withColumns(scaled)


def class_weights(df: DataFrame, label: str, mode: str = "balanced") -> DataFrame:
    """Adds ``weight``: n / (2 n_class), or for positives neg/pos (``ratio``) or its root (``sqrt``) and 1 for negatives."""
    n = df.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    pos, neg = n["p"] or 0, (n["n"] or 0) - (n["p"] or 0)
    if mode == "balanced":
        w = {1: n["n"] / (2 * pos) if pos else 1.0, 0: n["n"] / (2 * neg) if neg else 1.0}
    else:
        ratio = neg / pos if pos else 1.0
        w = {1: ratio if mode == "ratio" else ratio**0.5, 0: 1.0}
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(w[1]))).otherwise(F.lit(float(w[0]))))


# ---- estimators


def _predict(model, df: DataFrame, label: str) -> DataFrame:
    out = model.transform(df).withColumn("y_prob", vector_to_array("probability")[1])
    return out.withColumn("y_true", F.col(label).cast("int"))


def _choose(scored: DataFrame, metric: str, decimals: int, last: str = "hss") -> tuple[int, float]:
    """Number and threshold of the candidate whose validation scores are best, by (metric at its best threshold, average
    precision, skill; or, where ``last`` is brier, the least Brier score), the first on ties. ``scored`` has a candidate's number
    ``trial``, a row's label ``y_true`` and its probability ``prob``, so all are judged by the same few aggregations."""
    rows = materialise(scored.select("trial", "y_true", F.round("prob", decimals).alias("y_prob")), "candidates")
    top = select_threshold(rows, ["trial"], metric=metric)
    ap = ranking_metrics(rows, ["trial"]).select("trial", "pr_auc")
    brier = rows.groupBy("trial").agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), F.lit(2.0))).alias("brier"))
    order = [F.coalesce(metric, F.lit(0.0)), F.coalesce("pr_auc", F.lit(0.0)), -F.coalesce("brier", F.lit(0.0)) if last == "brier" else F.coalesce("hss", F.lit(0.0)), -F.col("trial")]
    best = top.join(ap, "trial").join(brier, "trial").agg(F.max_by(F.struct("trial", "threshold"), F.struct(*order)).alias("b")).first()["b"]
    return (best["trial"], best["threshold"]) if best else (0, 0.5)


def _by_trial(rows: DataFrame, probs: Sequence[Column]) -> DataFrame:
    """``(trial, y_true, prob)`` from rows with a probability by each candidate."""
    return rows.select("y_true", F.posexplode(F.array(*probs)).alias("trial", "prob"))


def _best(fitted: Sequence[tuple[dict, object]], val: DataFrame, label: str, metric: str, decimals: int, last: str = "hss") -> tuple[dict, object, float]:
    """``_choose`` over fitted pipelines."""
    out = val.withColumn("y_true", F.col(label).cast("int"))
    for i, (_, model) in enumerate(fitted):
        scored = model.transform(out).withColumn(f"prob_{i}", vector_to_array("probability")[1])
        out = scored.drop("features", "rawPrediction", "probability", "prediction")
    i, threshold = _choose(_by_trial(out, [F.col(f"prob_{i}") for i in range(len(fitted))]), metric, decimals, last)
    return *fitted[i], threshold


def logistic_grid(df: DataFrame, features: Sequence[str], label: str, grid: Sequence[float] = C_GRID, metric: str = "f2", split: str = "split", decimals: int = 4) -> tuple[dict, object, DataFrame]:
    """L2 logistic regression for each C, the best by validation; ``(choice, model, predictions)`` with 0/1 ``y_pred``.

    C divides the penalty of the summed, weighted loss; Spark penalises the weighted mean, hence regParam = 1 / (C Σw).
    """
    ready = materialise(class_weights(impute_and_scale(df, features, split), label), "ready")  # each fit reads it
    train, val = ready.where(F.col(split) == "train"), ready.where(F.col(split) == "val")
    total = train.agg(F.sum("weight")).first()[0]
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    fitted = []
    for c in grid:
        lr = LogisticRegression(labelCol=label, weightCol="weight", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200)
        fitted.append(({"C": c}, Pipeline(stages=[vector, lr]).fit(train)))
    choice, model, threshold = _best(fitted, val, label, metric, decimals)
    out = _predict(model, ready, label).withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int"))
    return choice | {"threshold": threshold}, model, out


def boosted_trees(
    df: DataFrame, features: Sequence[str], label: str, grid: Sequence[dict] | None = None, metric: str = "f2", split: str = "split", decimals: int = 4, early_stop: bool = False, last: str = "hss"
) -> tuple[dict, object, DataFrame]:
    """Level-wise boosted trees over a grid of parameters, median-imputed and with balanced weights; as ``logistic_grid``.

    With ``early_stop`` training also sees the validation rows, marked, and stops when their loss no longer falls.
    """
    grid = grid or [{"maxDepth": 3, "maxIter": 20}, {"maxDepth": 5, "maxIter": 20}, {"maxDepth": 5, "maxIter": 40}]
    ready = class_weights(impute_and_scale(df, features, split, scale=False), label).withColumn("is_val", F.col(split) == "val")
    ready = materialise(ready, "ready")  # each fit reads it
    train, val = ready.where(F.col(split) == "train"), ready.where(F.col(split) == "val")
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    fitted = []
    for params in grid:
        gbt = GBTClassifier(labelCol=label, weightCol="weight", seed=42, **params)
        if early_stop:
            gbt = gbt.setValidationIndicatorCol("is_val")
            gbt.set(gbt.validationTol, 0.001)
        fitted.append((params, Pipeline(stages=[vector, gbt]).fit(train.unionByName(val) if early_stop else train)))
    choice, model, threshold = _best(fitted, val, label, metric, decimals, last)
    out = _predict(model, ready, label).withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int"))
    return choice | {"threshold": threshold}, model, out


def _leafwise(df: DataFrame, label: str, models: Sequence[Model], forecasts: DataFrame, metric: str, decimals: int, last: str) -> tuple[Model, float, DataFrame]:
    """The best of fitted leaf-wise models by what they forecast of the validation rows, its threshold, and its predictions of all rows."""
    i, threshold = _choose(forecasts, metric, decimals, last)
    out = df.withColumn("y_true", F.col(label).cast("int")).withColumn("y_prob", models[i].probability())
    out = materialise(out, "scored")  # each metric reads it
    return models[i], threshold, out.withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int"))


def leafwise_grid(
    df: DataFrame, features: Sequence[str], label: str, grid: Sequence[dict] = LEAF_GRID, metric: str = "f2", split: str = "split", decimals: int = 4
) -> tuple[dict, Model, DataFrame]:
    """Leaf-wise boosted trees over a grid, median-imputed and with balanced weights, the best by validation;
    ``(choice, model, predictions)`` as ``logistic_grid``."""
    ready = materialise(class_weights(impute_and_scale(df, features, split, scale=False), label), "ready")
    models = fit_leafwise(ready, features, label, [Params(**p) for p in grid], "weight", split)
    val = ready.where(F.col(split) == "val").where(F.col(label).isNotNull()).withColumn("y_true", F.col(label).cast("int"))
    model, threshold, out = _leafwise(ready, label, models, _by_trial(val, [m.probability() for m in models]), metric, decimals, "hss")
    return asdict(model.params) | {"threshold": threshold}, model, out


def tuned_trees(
    df: DataFrame, features: Sequence[str], label: str, trials: int = TRIALS, seed: int = 42, patience: int = 100, rounds: int = 4000, metric: str = "f2", split: str = "split", decimals: int = 4
) -> tuple[dict, Model, DataFrame]:
    """Leaf-wise boosted trees over seeded draws of nine parameters, side by side over one stored table; each stops once
    ``patience`` rounds bring no lower validation log loss and keeps the trees up to the lowest. Nulls are 0, classes are not
    weighted, and the choice is by (metric, average precision, least Brier score)."""
    zeros = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    ready = materialise(zeros, "ready")
    forecasts: list[DataFrame] = []
    models = fit_leafwise(ready, features, label, search_draws(trials, seed, rounds), None, split, patience, forecasts)
    model, threshold, out = _leafwise(ready, label, models, forecasts[0], metric, decimals, "brier")
    return asdict(model.params) | {"threshold": threshold, "best_iteration": len(model.trees)}, model, out


def tree_importances(spark: SparkSession, model: Model) -> DataFrame:
    """``(feature, split_importance, gain_importance, gain_share)`` of a leaf-wise model: how often each feature splits a node
    and what that gains, also as a share of all."""
    found = model.importances()
    total = max(sum(g for _, _, g in found), 1e-12)
    rows = [(f, float(n), float(g), g / total) for f, n, g in found]
    return spark.createDataFrame(rows, "feature string, split_importance double, gain_importance double, gain_share double")


#: The trees whose splits and gains are parts of the importance score.
IMPORTANCE_TREES = {"n_estimators": 300, "learning_rate": 0.05, "num_leaves": 63, "subsample": 0.8, "colsample_bytree": 0.8}


def feature_importance(df: DataFrame, features: Sequence[str], label: str, split: str = "split", trees: dict | None = None, neighbours: int | None = 3) -> DataFrame:
    """One row a feature: mutual information and absolute rank correlation with the label, split and gain importance of
    leaf-wise trees, each part divided by its largest, their weighted sum ``importance_score``, and the rows and event rate it
    was learnt from. All parts come from the training rows, median-imputed but for the correlation; positives weigh as all
    negatives do in the trees. Mutual information is by nearest neighbours, or in ten quantile bins if ``neighbours`` is None."""
    spark = df.sparkSession
    train = materialise(df.where((F.col(split) == "train") & F.col(label).isNotNull()).select(*features, label, split), "train")
    filled = materialise(class_weights(impute_and_scale(train, features, split, scale=False), label, "ratio"), "filled")
    (model,) = fit_leafwise(filled, features, label, [Params(**(trees or IMPORTANCE_TREES))], "weight", split)
    if neighbours is None:
        information = quantile_mutual_information(filled, features, label, split)
    else:
        information = neighbour_information(stacked(filled, features, label), ["feature"], "x", "y", neighbours)
    parts = [information, abs_spearman(train, features, label), tree_importances(spark, model)]
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    size = train.agg(F.count("*").alias("train_rows_used"), F.avg(label).alias("event_rate"))
    return importance_ensemble(parts, names).crossJoin(F.broadcast(size))  # one row


def gain_shares(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Importance shares of a fitted boosted model, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    return sorted(((f, float(v) / total) for f, v in zip(features, values, strict=True)), key=lambda x: (-x[1], x[0]))


def metrics_of(predictions: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Scores of a prediction table per split."""
    return confusion_metrics(predictions, keys).join(ranking_metrics(predictions, keys), list(keys), "left")


def prediction_columns(df: DataFrame, ids: Sequence[str], threshold: Column | None = None) -> DataFrame:
    """The one schema of prediction tables."""
    extra = [threshold.alias("threshold")] if threshold is not None else []
    return df.select(*ids, "y_true", "y_prob", "y_pred", *extra)
