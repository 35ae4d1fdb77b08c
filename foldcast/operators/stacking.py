"""Aligning base forecasts and stacking them: ridge blend and direction classifier."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from foldcast.functions import columns as C
from foldcast.operators.calibration import exact_quantiles
from foldcast.operators.folds import head_flag
from foldcast.operators.joins import attach
from foldcast.operators.series import SeriesSpec, number_rows
from foldcast.session import materialise

# Executors need not have this package installed: its small solvers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Labels, ridge penalties, least aligned rows for a fit.
HYBRID = "Hybrid Meta (Regressor)"
HYBRID_CLF = "Hybrid Meta (Classifier)"
ALPHAS = (0.1, 1.0, 10.0)
MIN_ALIGNED = 10

TRAIN_BYTES = 64 << 20  # bytes of training rows in one partition


def align_predictions(preds: DataFrame, models: dict[str, str], on: str = "target") -> DataFrame:
    """One row per symbol, fold and date with every model's prediction; dates missing from any model drop out.

    ``models`` maps an output column to a model name; the first one supplies
    ``y_true``. ``on="target"`` compares forecasts of the same day.
    ``on="origin_of_first"`` dates the first model by the day it was made and
    the others by the day they are for, which pairs forecasts of different days.
    One shuffle, whatever the number of models.
    """
    lead = next(iter(models.values()))
    used = preds.where(F.col("model").isin(list(models.values())))
    is_lead = F.col("model") == lead
    if on == "origin_of_first":
        used = used.withColumn("date", F.when(is_lead, F.col("origin_date")).otherwise(F.col("date")))
    wide = used.groupBy("symbol", "fold_id", "date").agg(
        F.max(F.when(is_lead, F.col("origin_date"))).alias("origin_date"),
        F.max(F.when(is_lead, F.col("y_true"))).alias("y_true"),
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(c) for c, m in models.items()],
    )
    return wide.na.drop("any", subset=["y_true", *models])


def number_aligned(aligned: DataFrame) -> DataFrame:
    """Positions of aligned rows in fold and date order; folds serve as blocks."""
    return number_rows(aligned, SeriesSpec(), block="fold_id")


def join_context(aligned: DataFrame, features: DataFrame) -> DataFrame:
    """Add the day's VIX; days without one take the median over the symbol's aligned days."""
    joined = aligned.join(features.select("symbol", "date", "VIX"), ["symbol", "date"], "left")
    median = exact_quantiles(joined, ("symbol",), "VIX", (0.5,)).select("symbol", F.col("q0").alias("_median"))
    return attach(joined, median, ["symbol"], "left").withColumn("VIX", F.coalesce("VIX", "_median")).drop("_median")


def join_current_close(aligned: DataFrame, features: DataFrame, on: str = "origin_date") -> DataFrame:
    """Add the close known when the forecast was made; gaps take the last earlier, then the first later value."""
    closes = features.select("symbol", F.col("date").alias(on), F.col("close").alias("current_close"))
    joined = aligned.join(closes, ["symbol", on], "left")
    return number_rows(joined, SeriesSpec(), fills=("current_close",), block="fold_id")


def meta_matrix(aligned: DataFrame, features: DataFrame) -> DataFrame:
    """Numbered rows of the blend: base predictions, and VIX where the features have it."""
    rows = join_context(aligned, features) if "VIX" in features.columns else aligned
    return number_aligned(rows)


def ridge_grams(matrix: DataFrame, inputs: list[str], target: str = "y_true") -> DataFrame:
    """Means, then sums of centred products over each symbol's training rows (the first 80 %).

    Two aggregates because raw sums of squares lose digits at price level.
    """
    train = matrix.where(head_flag(0.8)).select("symbol", target, *inputs)
    means = materialise(train.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_train"), *[F.avg(c).alias(f"mean_{c}") for c in [*inputs, target]]
    ))
    d = {c: F.col(c) - F.col(f"mean_{c}") for c in [*inputs, target]}
    pairs = [(a, b) for i, a in enumerate(inputs) for b in [*inputs[i:], target]]
    grams = attach(train, means, ["symbol"], stored=True).groupBy("symbol").agg(*[F.sum(d[a] * d[b]).alias(f"g_{a}_{b}") for a, b in pairs])
    return means.join(grams, "symbol")


def _solve(grams: DataFrame, inputs: list[str], target: str, alphas: tuple[float, ...]) -> DataFrame:
    """Coefficients and (X'X + aI)^-1 for every symbol and penalty; works on one small row per symbol."""
    k = len(inputs)
    schema = "symbol string, alpha double, n_train long, intercept double, coef array<double>, means array<double>, inv array<double>"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = np.empty((len(pdf), k, k))
            for i, a in enumerate(inputs):
                for j in range(i, k):
                    g[:, i, j] = g[:, j, i] = pdf[f"g_{a}_{inputs[j]}"]
            b = pdf[[f"g_{a}_{target}" for a in inputs]].to_numpy(float)
            x_mean = pdf[[f"mean_{a}" for a in inputs]].to_numpy(float)
            for alpha in alphas:
                inv = np.linalg.inv(g + alpha * np.eye(k))
                coef = np.einsum("nij,nj->ni", inv, b)
                yield pd.DataFrame({
                    "symbol": pdf["symbol"],
                    "alpha": alpha,
                    "n_train": pdf["n_train"],
                    "intercept": pdf[f"mean_{target}"] - (coef * x_mean).sum(axis=1),
                    "coef": list(coef),
                    "means": list(x_mean),
                    "inv": list(inv.reshape(len(pdf), -1)),
                })

    return grams.mapInPandas(solve, schema)


def linear(inputs: list[str]) -> Column:
    """intercept + coef . inputs"""
    return sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(inputs)), F.col("intercept"))


def ridge_fit(matrix: DataFrame, inputs: list[str], target: str = "y_true", alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """One row per symbol: the penalty with the least leave-one-out error, its coefficients and intercept.

    The leave-one-out residual of a row is e / (1 - h), a row expression, so
    all penalties of all symbols are judged in one aggregate.
    """
    fits = materialise(_solve(ridge_grams(matrix, inputs, target), inputs, target, alphas))
    k = len(inputs)
    train = matrix.where(head_flag(0.8)).select("symbol", target, *inputs)
    rows = attach(train, fits, ["symbol"], stored=True)
    d = [F.col(c) - F.col("means")[i] for i, c in enumerate(inputs)]
    lever = sum((d[i] * d[j] * F.col("inv")[i * k + j] for i in range(k) for j in range(k)), 1.0 / F.col("n_train"))
    left_out = C.ratio(F.col(target) - linear(inputs), 1.0 - lever)
    errors = rows.groupBy("symbol", "alpha").agg(F.avg(left_out * left_out).alias("loo_mse"))
    best = errors.groupBy("symbol").agg(F.min_by("alpha", F.struct("loo_mse", "alpha")).alias("alpha"), F.min("loo_mse").alias("loo_mse"))
    return fits.join(best, ["symbol", "alpha"]).drop("means", "inv")


def ridge_predict(matrix: DataFrame, fit: DataFrame, inputs: list[str]) -> DataFrame:
    """Blend on all rows: ``y_pred``, and ``residual`` on the last 20 % that the fit has not seen."""
    scored = attach(matrix, fit.select("symbol", "intercept", "coef"), ["symbol"]).withColumn("y_pred", linear(inputs))
    held_out = ~head_flag(0.8)
    return scored.withColumn("residual", F.when(held_out, F.col("y_true") - F.col("y_pred"))).drop("intercept", "coef")


def residual_std(scored: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return scored.groupBy(*keys).agg(F.stddev_pop("residual").alias("residual_std"), F.count("residual").alias("n_residuals"))


def simple_average(wide: DataFrame, inputs: list[str], out: str = "hybrid") -> DataFrame:
    """Plain mean of the base forecasts: used where too few dates align for a blend."""
    return wide.withColumn(out, sum((F.col(c) for c in inputs), F.lit(0.0)) / len(inputs))


def enough_aligned(aligned: DataFrame) -> DataFrame:
    """Symbols with more than ten aligned rows."""
    return aligned.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_aligned")).where(F.col("n_aligned") > MIN_ALIGNED)


def direction_features(rows: DataFrame, inputs: list[str]) -> DataFrame:
    """Each base forecast and the target as up (1) or not (0) against the close known at forecast time."""
    up = {f"{c}_dir": F.when(F.col(c) > F.col("current_close"), 1).otherwise(0) for c in inputs}
    return rows.withColumns(up).withColumn("label", F.when(F.col("y_true") > F.col("current_close"), 1).otherwise(0))


def direction_classifier(rows: DataFrame, inputs: list[str], max_iter: int = 100, max_depth: int = 3, step: float = 0.05, seed: int = 42):
    """Boosted direction classifier fitted on the first 80 % of each symbol's rows; returns (model, all rows scored).

    Inputs are 0 or 1 and a value per day, so rows that agree in all of them and in the label are one row with their count as
    weight: the fit sees at most a row per day and pattern, however many symbols there are.
    """
    names = [f"{c}_dir" for c in inputs] + (["VIX"] if "VIX" in rows.columns else [])
    assembler = VectorAssembler(inputCols=names, outputCol="meta")
    distinct = rows.where(head_flag(0.8)).groupBy(*names, "label").agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    train = assembler.transform(distinct).select("meta", "label", "_weight")
    size = train.count() * (8 * len(names) + 40)
    train = train.repartition(max(1, size // TRAIN_BYTES)).persist()
    try:
        model = GBTClassifier(
            featuresCol="meta", labelCol="label", weightCol="_weight", maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed
        ).fit(train)
    finally:
        train.unpersist()
    scored = model.transform(assembler.transform(rows)).drop("meta", "rawPrediction", "probability")
    return model, scored.withColumn("prediction", F.col("prediction").cast("int"))
