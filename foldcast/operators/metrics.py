"""Direction and error metrics per fold and pooled over folds.

Input is a long table of predictions: symbol, model, fold_id, date, y_true,
y_pred. One pass reduces each fold (at most the test size in rows) to a row of
sums; pooled metrics add those rows up. A pooled series also has a return
across every fold edge, so each fold row keeps its first and last values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldcast.functions import columns as C

COUNTS = ("tn", "fp", "fn", "tp")

# Metric columns of a report, in order.
REPORT_METRICS = ["directional_accuracy", "f1", "precision", "recall", "rmse", "mae", "mape", "r2", "max_error"]


def confusion_counts(actual: Column, predicted: Column) -> dict[str, Column]:
    """Four conditional sums over rows whose actual move is significant; a flat prediction counts as down."""
    up = F.when(predicted == 1, F.lit(1)).otherwise(F.lit(0))
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return {name: F.coalesce(F.sum(((actual == a) & (up == p)).cast("long")), F.lit(0)) for name, (a, p) in cells.items()}


def classification_from_counts(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Accuracy in percent and macro precision, recall and F1, unrounded; NULL without significant moves.

    The macro mean runs over the classes that occur in actual or predicted
    values; an undefined precision or recall counts as 0.
    """
    tn, fp, fn, tp = [c.cast("double") for c in (tn, fp, fn, tp)]
    total = tn + fp + fn + tp
    down_seen = F.when(tn + fp + fn > 0, 1.0).otherwise(0.0)
    up_seen = F.when(tp + fp + fn > 0, 1.0).otherwise(0.0)
    classes = down_seen + up_seen

    def macro(down: Column, up: Column) -> Column:
        return F.when(total > 0, C.ratio(C.or_default(down, 0.0) + C.or_default(up, 0.0), classes))

    return {
        "directional_accuracy": C.ratio(100.0 * (tn + tp), total),
        "precision": macro(C.ratio(tn, tn + fn), C.ratio(tp, tp + fp)),
        "recall": macro(C.ratio(tn, tn + fp), C.ratio(tp, tp + fn)),
        "f1": macro(C.ratio(2 * tn, 2 * tn + fp + fn), C.ratio(2 * tp, 2 * tp + fp + fn)),
    }


def _fold_sums(preds: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    w = Window.partitionBy(*keys, "fold_id").orderBy("date")
    y, p = F.col("y_true"), F.col("y_pred")
    labelled = preds.withColumns({
        "_actual": C.direction_label(y, F.lag("y_true").over(w), threshold),
        "_guess": C.direction_label(p, F.lag("y_pred").over(w), threshold),
    })
    e = y - p
    return labelled.groupBy(*keys, "fold_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[c.alias(name) for name, c in confusion_counts(F.col("_actual"), F.col("_guess")).items()],
        F.sum(e * e).alias("sse"),
        F.sum(F.abs(e)).alias("sae"),
        F.sum(F.abs(C.ratio(e, y))).alias("sape"),
        F.count(F.when(y != 0, 1)).alias("nz"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("m2"),
        *[f(c, "date").alias(f"_{side}_{c}") for side, f in (("first", F.min_by), ("last", F.max_by)) for c in ("y_true", "y_pred")],
    )


def _pooled_sums(fold_sums: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Add up fold rows, with the return across each fold edge; spread of y around a shifted mean keeps its digits."""
    w = Window.partitionBy(*keys).orderBy("fold_id")
    edged = fold_sums.withColumns({
        "_actual": C.direction_label(F.col("_first_y_true"), F.lag("_last_y_true").over(w), threshold),
        "_guess": C.direction_label(F.col("_first_y_pred"), F.lag("_last_y_pred").over(w), threshold),
        "_shift": F.first("mean").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    edge = confusion_counts(F.col("_actual"), F.col("_guess"))
    n, off = F.col("n"), F.col("mean") - F.col("_shift")
    pooled = edged.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[(F.sum(name) + edge[name]).alias(name) for name in COUNTS],
        *[F.sum(c).alias(c) for c in ("sse", "sae", "sape", "nz")],
        F.max("max_error").alias("max_error"),
        F.sum("m2").alias("_inner"),
        F.sum(n * off).alias("_s1"),
        F.sum(n * off * off).alias("_s2"),
    )
    return pooled.withColumn("m2", F.col("_inner") + F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("n"))


def _finish(sums: DataFrame, keep: list[str]) -> DataFrame:
    n = F.col("n").cast("double")
    mse = F.col("sse") / n
    r2 = (
        F.when(F.col("n") < 2, F.lit(None))
        .when(F.col("m2") > 0, 1.0 - C.ratio(F.col("sse"), F.col("m2")))
        .when(F.col("sse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    cls = classification_from_counts(*[F.col(c) for c in COUNTS])
    digits = {"directional_accuracy": 2, "f1": 4, "precision": 4, "recall": 4}
    return sums.select(
        *keep, "n", *COUNTS,
        *[F.bround(cls[name], d).alias(name) for name, d in digits.items()],
        F.bround(mse, 4).alias("mse"),
        F.bround(F.sqrt(mse), 4).alias("rmse"),
        F.bround(F.col("sae") / n, 4).alias("mae"),
        F.bround(100.0 * C.ratio(F.col("sape"), F.col("nz")), 2).alias("mape"),
        F.bround(r2, 4).alias("r2"),
        F.bround("max_error", 4).alias("max_error"),
    )


def metrics_by_fold(preds: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), threshold: float = C.DIRECTION_THRESHOLD) -> DataFrame:
    """Metrics of every fold on its own."""
    keys = list(keys)
    return _finish(_fold_sums(preds, keys, threshold), [*keys, "fold_id"])


def pooled_metrics(preds: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), threshold: float = C.DIRECTION_THRESHOLD) -> DataFrame:
    """Metrics of all folds taken as one series in fold and date order (not the mean of the folds)."""
    keys = list(keys)
    return _finish(_pooled_sums(_fold_sums(preds, keys, threshold), keys, threshold), keys)


def fold_and_pooled_metrics(preds: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), threshold: float = C.DIRECTION_THRESHOLD) -> DataFrame:
    """Both levels in one table; ``fold_id`` is NULL in pooled rows."""
    keys = list(keys)
    sums = _fold_sums(preds, keys, threshold)
    pooled = _finish(_pooled_sums(sums, keys, threshold), keys)
    return _finish(sums, [*keys, "fold_id"]).unionByName(pooled.withColumn("fold_id", F.lit(None).cast("int")))


def compare_models(metrics: DataFrame) -> DataFrame:
    """Comparison table: one row per symbol and model, without the confusion matrix."""
    return metrics.select("symbol", "model", *[c for c in REPORT_METRICS if c in metrics.columns])


def direction_clf_metrics(scored: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Metrics of a direction classifier (label, prediction as 0/1), not rounded; error metrics do not apply."""
    counts = confusion_counts(F.col("label"), F.col("prediction"))
    sums = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in counts.items()])
    cls = classification_from_counts(*[F.col(c) for c in COUNTS])
    missing = [F.lit(None).cast("double").alias(c) for c in ("rmse", "mae", "mape", "r2", "max_error")]
    return sums.select(*keys, "n", *COUNTS, *[c.alias(name) for name, c in cls.items()], *missing)
