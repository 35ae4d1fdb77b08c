"""The whole flow as one function over lazy tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldcast.operators import baselines, calibration, forecast, learners, metrics, stacking
from foldcast.operators.folds import FoldSpec, fold_split, fold_summary, require_folds, series_lengths
from foldcast.operators.series import SeriesSpec
from foldcast.schema import PREDICTION_COLUMNS
from foldcast.session import materialise, scratch_path
from foldcast.sources import sinks
from foldcast.sources.bars import prepare

# Output column of each base learner in aligned tables.
INPUTS = {"tree_pred": learners.TREE, "huber_pred": learners.HUBER, "fm_pred": learners.FM}


@dataclass(frozen=True)
class RunConfig:
    future_days: int = 30
    optimize: bool = False
    folds: FoldSpec = FoldSpec()
    tree: learners.TreeConfig = learners.TreeConfig()
    sequence: learners.SequenceConfig = learners.SequenceConfig()
    clf_rounds: int = 100
    level: float = 0.95
    align_on: str = "target"
    spec: SeriesSpec = SeriesSpec()


@dataclass(frozen=True)
class RunResult:
    features: DataFrame
    folds: DataFrame
    fold_summary: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    fold_metrics: DataFrame
    comparison: DataFrame
    aligned: DataFrame
    coefficients: DataFrame | None
    calibration: DataFrame | None
    calibration_held_out: DataFrame | None
    forecast: DataFrame
    runs: dict[str, learners.LearnerRun] = field(default_factory=dict)
    path: str = ""


@dataclass(frozen=True)
class RunFolder:
    """The output folder of a run: one Parquet table per finished stage, and ``manifest`` with a row for each.

    A stage is in the manifest only when its table is written, so a run that was cut off starts again after the last one.
    """

    spark: SparkSession
    path: str

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("stage string, file string, written long").parquet(f"{self.path}/manifest")

    def finished(self) -> set[str]:
        try:
            return {r["stage"] for r in self.manifest().select("stage").collect()}
        except AnalysisException:  # a new folder
            return set()

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; ``make`` is called only where it is not there yet."""
        file = f"{self.path}/{name}"
        if name not in self.finished():
            make().write.mode("overwrite").parquet(file)
            written = self.spark.read.parquet(file).count()
            row = self.spark.createDataFrame([(name, file, written)], "stage string, file string, written long")
            row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self.spark.read.parquet(file)


def run_contents(spark: SparkSession, path: str) -> DataFrame:
    """``stage, written, rows``: what the manifest says of each table, and the rows that are read back from it."""
    listed = RunFolder(spark, path).manifest()
    counts = [spark.read.parquet(r["file"]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(r["stage"]).alias("stage"), "rows") for r in listed.collect()]
    return listed.select("stage", "written").join(_union(counts), "stage", "left")


def run_all(bars: DataFrame, macro: DataFrame | None = None, config: RunConfig = RunConfig(), path: str | None = None) -> RunResult:
    """Features, folds, base learners, baselines, stacking, intervals, forecast and comparison for all symbols.

    Every stage is written below ``path`` (else below the shared folder) and read back by the next ones; a second call with the
    same ``path`` goes on where the first one ended, down to single folds of the tree ensemble. Forecasts, the comparison and the
    combined forecast are also written as CSV.
    """
    spark, spec = bars.sparkSession, config.spec
    out = RunFolder(spark, (path or scratch_path(spark, "run")).rstrip("/"))
    features = out.stage("features", lambda: prepare(bars, macro, spec))
    folds = require_folds(out.stage("folds", lambda: fold_split(series_lengths(features), config.folds)))

    def models(name: str) -> str:
        return f"{out.path}/models/{name.lower().replace(' ', '_')}"

    def fit() -> DataFrame:
        store = learners.FoldStore(spark, f"{out.path}/fold_models")
        fitted = learners.train_base_models(features, config.folds, config.tree, config.sequence, config.optimize, spec, store)
        for name, run in fitted.items():
            learners.save_run(run, models(name))
        return _union([r.predictions for r in fitted.values()])

    base = out.stage("base", fit)
    runs = {name: learners.load_run(spark, models(name)) for name in INPUTS.values()}
    plain = out.stage("plain", lambda: baselines.run_baselines(features, config.folds, spec))

    aligned = stacking.align_predictions(base, INPUTS, config.align_on)
    rich = stacking.enough_aligned(aligned)
    matrix = out.stage("aligned", lambda: stacking.meta_matrix(aligned.join(rich.select("symbol"), "symbol", "left_semi"), features))
    future = out.stage("future", lambda: _union([forecast.forecast_recursive(features, r, config.future_days) for r in runs.values()]))
    wide = future.groupBy("symbol", "step", "date").agg(
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(c) for c, m in INPUTS.items()]
    )

    tables = [base, plain]
    fit_table = report = held_out = clf = None
    if matrix.isEmpty():
        outlook = stacking.simple_average(wide, list(INPUTS)).withColumns({"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double")})
    else:
        inputs = [*INPUTS] + (["VIX"] if "VIX" in matrix.columns else [])
        fit_table = out.stage("coefficients", lambda: stacking.ridge_fit(matrix, inputs))
        scored = out.stage("blend", lambda: stacking.ridge_predict(matrix, fit_table, inputs).withColumn("model", F.lit(stacking.HYBRID)))
        tables.append(scored.select(*PREDICTION_COLUMNS))
        offsets = out.stage("offsets", lambda: calibration.quantile_offsets(scored, ("symbol",), config.level))
        vix = calibration.vix_stats(features)
        bounded = calibration.with_interval(scored, offsets, vix)
        report = out.stage("calibration", lambda: calibration.coverage_report(bounded, ("symbol", "model"), config.level, "n_residuals"))
        unseen = bounded.where(F.col("residual").isNotNull())
        held_out = out.stage("calibration_held_out", lambda: calibration.coverage_report(unseen, ("symbol", "model"), config.level, "n_residuals"))
        clf = out.stage("direction", lambda: _direction(aligned, features, config))
        blended = forecast.future_interval(wide, fit_table, offsets, vix, list(INPUTS), "VIX" in inputs)
        averaged = stacking.simple_average(wide.join(rich.select("symbol"), "symbol", "left_anti"), list(INPUTS))
        outlook = blended.unionByName(averaged, allowMissingColumns=True)

    hybrid = outlook.select("symbol", F.lit(stacking.HYBRID).alias("model"), "step", "date", F.col("hybrid").alias("y_pred"), "lower", "upper")
    ahead = out.stage("forecast", lambda: future.unionByName(hybrid, allowMissingColumns=True))
    predictions = out.stage("predictions", lambda: _union([t.select(*PREDICTION_COLUMNS) for t in tables]))
    pooled = metrics.pooled_metrics(predictions)
    pooled = out.stage("metrics", lambda: pooled if clf is None else pooled.unionByName(clf, allowMissingColumns=True))
    fold_metrics = out.stage("fold_metrics", lambda: metrics.metrics_by_fold(predictions))
    summary = out.stage("fold_summary", lambda: fold_summary(features, config.folds))
    comparison = out.stage("comparison", lambda: metrics.compare_models(pooled))
    out.stage("importance", lambda: learners.feature_importance(runs[learners.TREE]))
    combined = out.stage("combined", lambda: sinks.combined_forecast(ahead, {m: m for m in [*INPUTS.values(), stacking.HYBRID]}))
    sinks.write_table(comparison, f"{out.path}/csv/model_comparison")
    sinks.write_table(combined, f"{out.path}/csv/combined_predictions")
    for name in [*INPUTS.values(), stacking.HYBRID]:
        sinks.write_forecast(ahead, sinks.forecast_path(f"{out.path}/csv", name), name)
    return RunResult(
        features=features,
        folds=folds,
        fold_summary=summary,
        predictions=predictions,
        metrics=pooled,
        fold_metrics=fold_metrics,
        comparison=comparison,
        aligned=matrix,
        coefficients=fit_table,
        calibration=report,
        calibration_held_out=held_out,
        forecast=ahead,
        runs=runs,
        path=out.path,
    )


def _direction(aligned: DataFrame, features: DataFrame, config: RunConfig) -> DataFrame:
    on = "origin_date" if config.align_on == "target" else "date"
    rows = stacking.join_current_close(aligned, features, on)
    rows = stacking.direction_features(rows, list(INPUTS))
    if "VIX" in features.columns:
        rows = stacking.join_context(rows, features)
    _, scored = stacking.direction_classifier(materialise(rows), list(INPUTS), config.clf_rounds)
    held_out = scored.where(~stacking.head_flag(0.8))
    return metrics.direction_clf_metrics(held_out).withColumn("model", F.lit(stacking.HYBRID_CLF))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
