"""foldcast: walk-forward forecasting analytics over many ordered price series, written as Spark DataFrame plans."""

from foldcast.operators.series import SeriesSpec
from foldcast.operators.indicators import engineer_features
from foldcast.operators.folds import FoldSpec

__all__ = ["SeriesSpec", "FoldSpec", "engineer_features"]
