"""The tables behind the reports and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldcast.operators.joins import attach
from foldcast.operators.metrics import COUNTS

# Metrics shown as bars.
BAR_METRICS = ["directional_accuracy", "f1", "rmse", "mae", "mape"]


def actual_vs_predicted(wide: DataFrame, models: list[str]) -> DataFrame:
    """Actual and predicted series in long form."""
    series = wide.select("symbol", "fold_id", "date", F.col("y_true").alias("actual"), *models)
    return series.unpivot(["symbol", "fold_id", "date"], ["actual", *models], "series", "value")


def residual_histogram(preds: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), bins: int = 40) -> DataFrame:
    """Equal-width residual counts per group; the top edge belongs to the last bin, empty bins are left out."""
    keys = list(keys)
    rows = preds.select(*keys, (F.col("y_true") - F.col("y_pred")).alias("_e"))
    span = rows.groupBy(*keys).agg(F.min("_e").alias("_low"), F.max("_e").alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    at = F.floor((F.col("_e") - low) * bins / (high - low)).cast("int")
    placed = attach(rows, span, keys).withColumn("bin", F.when(high > low, F.least(F.lit(bins - 1), at)).otherwise(F.lit(bins // 2)))
    width = (high - low) / bins
    return placed.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(low + F.col("bin") * width).alias("bin_low"),
        F.min(low + (F.col("bin") + 1) * width).alias("bin_high"),
    )


def metric_bars(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Key metrics in long form, those present."""
    present = [c for c in (names or BAR_METRICS) if c in metrics.columns]
    return metrics.select("symbol", "model", *[F.col(c).cast("double").alias(c) for c in present]).unpivot(
        ["symbol", "model"], present, "metric", "value"
    )


def top_importance(importances: DataFrame, top_n: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(top_n)


def confusion_cells(metrics: DataFrame) -> DataFrame:
    """The 2 x 2 matrix as four rows per model."""
    cells = [("DOWN", "DOWN", "tn"), ("DOWN", "UP", "fp"), ("UP", "DOWN", "fn"), ("UP", "UP", "tp")]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for a, p, c in cells]))
    return metrics.where(sum((F.col(c) for c in COUNTS), F.lit(0)) > 0).select("symbol", "model", each.alias("_c")).select("symbol", "model", "_c.*")


def forecast_band(forecast: DataFrame) -> DataFrame:
    """Forecast lines by date, with bounds where there are any."""
    bounds = [c for c in ("lower", "upper") if c in forecast.columns]
    return forecast.select("symbol", "model", "date", "y_pred", *bounds)


def fold_bands(summary: DataFrame) -> DataFrame:
    """Shaded test range of each fold."""
    return summary.select("symbol", "fold_id", "test_first", "test_last")


def last_rows(numbered: DataFrame, k: int) -> DataFrame:
    """The last k rows of each series; positions are known, so nothing is sorted."""
    return numbered.where(F.col("rn") >= F.col("n") - k)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """One text line per model."""
    shown = [("directional_accuracy", "%.2f%%"), ("f1", "%.4f"), ("precision", "%.4f"), ("recall", "%.4f"), ("rmse", "%.4f"), ("mae", "%.4f"), ("mape", "%.2f%%"), ("r2", "%.4f")]
    parts = [F.when(F.col(c).isNotNull(), F.format_string(f"{c}={fmt}", c)).otherwise(f"{c}=n/a") for c, fmt in shown]
    return metrics.select("symbol", "model", F.concat_ws(" ", *parts).alias("line"))
